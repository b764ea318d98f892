"""SimHash, line and embedding near-duplicates against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from lectern.llm import components, lines, simhash, vectors

from . import edge


def loop_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def loop_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_majority_of_bits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 254, 256, 257, 258, 1000):
        text = " ".join(rng.choice(("a", "B", "c,", "é", "dd")) for _ in range(n))
        assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == loop_fingerprint(text)


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(12)]
    rows, n = [], 0
    for text in base:
        for copy in range(6):
            words = text.split()
            for _ in range(copy // 2):
                words[rng.randrange(len(words))] = "changed"
            n += 1
            rows.append((n, " ".join(words), *[None] * 8))
    found = simhash.near_duplicates(edge.docs(spark, rows + [r for r in edge.ROWS if r[0] is not None and r[0] < 0])).collect()
    prints = {r[0]: loop_fingerprint(r[1]) for r in rows}
    want = loop_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == prints
    assert len(set(want.values())) < len(want)


def test_tiles_of_one_cell_all_meet(spark):
    # one crowded cell, cut into tiles of 8: a chain of fingerprints two bits apart stays connected
    prints = [0]
    for k in range(40):
        prints.append(prints[-1] ^ (1 << (k % 16)) ^ (1 << ((k * 7 + 1) % 16)))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, tile=8)).collect()}
    want = loop_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {p: got.get(p, p) for p in prints} == want


def test_simhash_edge_rows(spark):
    found = simhash.near_duplicates(edge.docs(spark)).collect()
    assert len(found) == len(edge.ROWS)
    ids = {(r.doc_id, r.fp == 0): r.component_id for r in found}
    assert ids[2, False] == ids[3, False] == 1
    assert ids[5, True] == ids[6, True] == ids[4, True] == ids[None, True] == 4
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1400)]
    df = spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, **{k: 1000 for k in range(1001, 1400)}}


def test_near_copies_by_similarity(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for size in (40, 120, 400, 900):
        text = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for changed in (0, 0, 1, size // 100):  # up to about five per cent of the shingles
            words = list(text)
            for at in rng.sample(range(size), changed):
                words[at] = f"x{n}"
            n += 1
            rows.append((n, " ".join(words), *[None] * 8))
        n += 1
        rows.append((n, " ".join(f"z{rng.randrange(5000)}" for _ in range(size)), *[None] * 8))
    found = {r.doc_id: r.component_id for r in simhash.near_copies(edge.docs(spark, rows)).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in rows}
    want = loop_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert found == want


def _variants(rng, size, copies, share):
    """Texts of different words, each with a random ``share`` of the words of one text replaced."""
    text = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    for _ in range(copies):
        words = list(text)
        for at in rng.sample(range(size), max(1, round(share * size))):
            words[at] = f"x{rng.randrange(10**9)}"
        yield " ".join(words)


def _components_of(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    return loop_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_near_copies_keep_every_link_at_the_limit(spark):
    rng = random.Random(11)
    texts = [t for _ in range(30) for t in _variants(rng, 244, 12, 0.0115)]  # groups whose members lie near 0.8
    docs = edge.docs(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])
    want = _components_of(texts)
    assert 30 < len(set(want.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs, block=(5, 2000)).collect()} == want


def test_near_copies_of_long_texts_are_exact(spark):
    rng = random.Random(12)
    texts = [t for _ in range(40) for t in _variants(rng, 1000, 2, 0.0115)]  # pairs near 0.8 of more than 256 shingles
    docs = edge.docs(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])
    want = _components_of(texts)
    assert 40 < len(set(want.values())) < 80
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want


def test_similar_sets_match_loop():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 55, replace=False), rng.integers(0, 2**63, k % 4).astype(np.uint64)]) for k in range(50)]
    sets += [np.empty(0, np.uint64), base[:1], base[:1], np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64)]
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2)
            if len(set(sets[a]) & set(sets[b])) / max(1, len(set(sets[a]) | set(sets[b]))) >= 0.8}
    assert set(zip(*(x.tolist() for x in simhash.similar(sets, 0.8)))) == want and (53, 54) in want


def test_one_document_of_each_group_stays(spark):
    docs = edge.docs(spark)
    kept = simhash.keep_one(docs, simhash.near_copies(docs))
    assert kept.columns == docs.columns
    rows = kept.collect()
    # 1 = 2 = 3; null, empty and white texts are one group; of equal rows one
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 7, 8, 9]
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.keep_one(edge.empty(spark), simhash.near_copies(edge.empty(spark))).count() == 0


def test_lines_on_many_sites_go_but_once(spark):
    rows = [(k, f"own line of document {k}\n shared line \nshared line\n\nend {k}", "en", f"s{k}", 1, *[None] * 5) for k in range(6)]
    rows += [(50 + k, f"long line of a near copy\nanother line of it\nend {k}", "en", f"s{k}", 1, *[None] * 5) for k in range(6)]  # mostly alike
    rows += [(100 + k, "copied text\nsecond line", "en", f"s{k}", 1, *[None] * 5) for k in range(6)]  # one text, copied
    docs = edge.docs(spark, rows)
    joined = lines.without_boilerplate(docs, sites=6, known_lines=0)
    assert edge.as_rows(joined) == edge.as_rows(lines.without_boilerplate(docs, sites=6))
    out = {r.doc_id: r for r in joined.collect()}
    assert out[0].text == "own line of document 0\n shared line \n\nend 0" and out[0].n_removed == 1 and out[0].n_lines == 5
    assert all(out[k].text == f"own line of document {k}\n\nend {k}" and out[k].n_removed == 2 for k in range(1, 6))
    # near copies: all but the first lose what they share, however little is left
    assert out[50].text == "long line of a near copy\nanother line of it\nend 0"
    assert all(out[50 + k].text == f"end {k}" and out[50 + k].n_removed == 2 for k in range(1, 6))
    assert all(out[100 + k].text == "copied text\nsecond line" for k in range(6))
    # one site fewer than the threshold
    assert all(r.n_removed == 0 for r in lines.without_boilerplate(edge.docs(spark, rows), sites=7).collect())


def test_lines_edge_rows(spark):
    docs = edge.docs(spark)
    out = lines.without_boilerplate(docs, sites=1)
    assert edge.as_rows(out) == edge.as_rows(lines.without_boilerplate(docs, sites=1, known_lines=0))
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by_id[4].text is None and by_id[4].n_lines == 0 and by_id[5].text == "" and by_id[5].n_lines == 1
    assert by_id[9].text == edge.ROWS[8][1]  # its lines stand in one text only
    assert len(by_id[7].text) == len(edge.LONG)
    assert out.count() == len(edge.ROWS) and lines.without_boilerplate(edge.empty(spark)).count() == 0


def test_hadamard_is_orthogonal():
    x = np.eye(16)
    y = vectors.hadamard(x)
    assert np.allclose(y @ y.T, x) and np.allclose(np.abs(y), 0.25)


@pytest.mark.parametrize("width", [16, 100, 768])
def test_vectors_just_above_the_limit_are_found(spark, width):
    """300 pairs of cosine 0.9805: the hardest that count."""
    rng = np.random.default_rng(width)
    a, turn = rng.normal(size=(2, 300, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    b = 0.9805 * a + math.sqrt(1 - 0.9805**2) * turn
    rows = [(2 * k + j, [float(v) for v in x[k]], 1) for j, x in enumerate((a, b)) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vectors.near_duplicates(df).filter("n_links > 0").count()
    assert found / 600 >= 0.99


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(30):
            base = rng.normal(size=24)
            for k in range(int(rng.integers(1, 8))):
                n += 1
                rows.append((n, [float(v) for v in base + (0.12 if k else 0) * rng.normal(size=24)], label))
    rows += [(n + 1 + k, rows[0][1], 1) for k in range(5)]  # exact copies
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [math.nan] * 24, 1), (503, [math.inf] + [1.0] * 23, 1), (504, [1.0, None], 1),
             (505, rows[0][1], None), (506, [], 1), (507, [1.0, 2.0], 1), (None, rows[0][1], 1), (507, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = vectors.near_duplicates(df, tile=4).collect()
    assert len(got) == len(rows)
    good = [(k, r) for k, r in enumerate(rows) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]

    def linked(a, b):
        (x, y), (lx, ly) = (rows[a][1], rows[b][1]), (rows[a][2], rows[b][2])
        return len(x) == len(y) and lx == ly and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    keys = [k for k, _ in good]
    roots = loop_components(keys, linked)
    want = []
    for k, r in enumerate(rows):
        links = sum(linked(k, o) for o in keys if o != k) if k in roots else 0
        group = [rows[o][0] for o in keys if roots.get(o) == roots.get(k) and rows[o][0] is not None] if k in roots else [r[0]]
        low = min(group)
        want.append((r[0], links, low, r[0] == low))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
