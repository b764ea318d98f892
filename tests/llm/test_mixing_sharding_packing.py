"""Mixing, sharding and packing: laws that must hold, and plain loops."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, sharding

from . import edge


def loop_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Rounds of sharing by weight until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > limit * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = limit * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def loop_apportion(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda u: (-votes[u] / (2 * got[u] + 1), u))
        got[best] += 1
    return got


def test_targets_match_the_rounds(spark):
    sizes = {"b": 1000, "a": 50, "é": 400, "Z": 3000, None: 70, "c": 10, "d": 0}
    df = spark.createDataFrame([("z" if s is None else "a" + s, n) for s, n in sizes.items()], "src string, source_size long")
    got = {r.src: r.target for r in mixing.targets(df).collect()}
    want = loop_targets(sizes)
    assert all(abs(got["z" if s is None else "a" + s] - t) < 1e-6 for s, t in want.items())


def test_apportion_gives_seats_to_the_highest_quotients(spark):
    for votes, seats in (({"a": 53, "b": 24, "c": 23}, 7), ({f"u{k:02d}": k * k + 1 for k in range(30)}, 11), ({"a": 5.0, "b": 5.0}, 3),
                         ({"a": 0.0, "b": 9.0}, 4), ({f"u{k:02d}": (k + 1) ** 3 for k in range(12)}, 500)):
        df = spark.createDataFrame([(u, float(v), seats) for u, v in votes.items()], "u string, v double, q long")
        assert {r.u: r.quota for r in mixing.apportion(df, [], "u", "v", "q").collect()} == loop_apportion(votes, seats)


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = [(k, " ".join(["w"] * (17 * k % 211)), "en", f"s{k % 7 if k % 3 else 0}", 1, *[None] * 5) for k in range(3000)]
    docs = edge.docs(spark, rows)
    first = mixing.mix(docs, block=50, shard_words=20_000).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix(docs.repartition(7), block=50, shard_words=20_000).collect()))
    words = {k: 17 * k % 211 for k in range(3000)}
    assert {r.doc_id: r.size for r in first} == words and all(0 <= r.taken <= 2 * r.size for r in first)
    by = collections.defaultdict(lambda: [0, 0])
    for r in first:
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] += r.size
    assert all(size == total and abs(taken - target) < 0.02 * target + 60 for (size, target), (taken, total) in by.items())
    whole = mixing.mixed(docs, block=50, shard_words=20_000)
    got = {r.source: r.w for r in whole.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    sizes = {s: sum(words[r[0]] for r in rows if r[3] == s) for s in got}
    want = loop_targets(sizes)
    shards = {s: max(1, -(-n // 20_000)) for s, n in sizes.items()}
    assert all(abs(got[s] - want[s]) < 0.02 * want[s] + 60 + 110 * shards[s] for s in want)
    assert max(r["count"] for r in whole.groupBy("doc_id").count().collect()) <= 2


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 10_000, "b": 5, "c": 3, "d": 200, "e": 41, "f": 1, None: 17}
    rows = []
    for s, n in sizes.items():
        while n:
            k = min(n, len(rows) % 37 + 1)
            rows.append((len(rows), " ".join(["w"] * k), "en", s, 1, *[None] * 5))
            n -= k
    taken = collections.Counter()
    source = {r[0]: r[3] for r in rows}
    for r in mixing.mix(edge.docs(spark, rows)).collect():
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size
    want = loop_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(1, 0.05 * want[s]) for s in sizes), (taken, want)


def test_mix_edge_rows(spark):
    docs = edge.docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edge.ROWS)
    assert all(r.size == r.taken == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert {r.size for r in rows if r.doc_id == 7} == {60_000}
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(edge.empty(spark)).count() == 0 and mixing.mixed(edge.empty(spark)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.filter("doc_id in (4, 5, 6)")).collect())


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        axes = [F.expr(f"cast((id >> {bits * k}) & {(1 << bits) - 1} as int)").alias(f"x{k}") for k in range(n)]
        grid = spark.range(1 << (n * bits)).select(*axes)
        rows = grid.withColumn("h", sharding.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(rows)))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_keep_groups_together(spark):
    rows = [(k, f"text {k % 300}", "en" if k % 3 else None, f"s{k % 11}", 1, *[None] * 5) for k in range(1003)]
    out = sharding.shards(edge.docs(spark, rows)).toPandas()
    counts = out.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert (out.groupby("text_crc32").shard.nunique() > 1).sum() <= 15
    edges = sharding.shards(edge.docs(spark)).collect()
    assert len(edges) == len(edge.ROWS) and sharding.shards(edge.empty(spark)).count() == 0
    by_id = {r.doc_id: r for r in edges}
    assert by_id[4].size == 1 and by_id[4].text_crc32 == 0 and by_id[9].text_crc32 == zlib.crc32(edge.ROWS[8][1].encode())
    assert by_id[9].size == len(edge.ROWS[8][1].encode()) + 1


def test_shards_follow_the_curve(spark):
    rows = [(k, f"text {k % 211} " + "x" * (k * k % 3001), ("en", "de", None)[k % 3], f"s{k % 9}" if k % 10 else None, 1, *[None] * 5) for k in range(700)]
    out = {r.doc_id: r for r in sharding.shards(edge.docs(spark, rows)).collect()}
    size = {r[0]: len(r[1].encode()) + 1 for r in rows}
    rank = lambda values, v: sorted(values, key=lambda x: (x is None, x)).index(v)
    step = lambda col, v: (lambda all_: math.floor(rank(all_, v) * min(1.0, 32 / len(all_))))({r[col] for r in rows})
    cell = {r[0]: (step(2, r[2]), step(3, r[3]), min(31, math.floor(math.log2(size[r[0]]) * 1.5))) for r in rows}
    cells = spark.createDataFrame(sorted(set(cell.values())), "a int, b int, c int")
    index = {tuple(r)[:3]: r.h for r in cells.withColumn("h", sharding.hilbert_index([F.col(x) for x in "abc"], 5)).collect()}
    group = collections.defaultdict(list)
    for r in rows:
        group[r[1]].append(index[cell[r[0]]])
    assert {k: r["index"] for k, r in out.items()} == {r[0]: min(group[r[1]]) for r in rows}
    along = [r["index"] for r in sorted(out.values(), key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)


def test_shard_files_hold_every_row(spark, tmp_path):
    docs = edge.docs(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), n=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert edge.as_rows(back.select(docs.columns)) == edge.as_rows(docs)


def test_best_two_fit_by_hand():
    # greedy takes 6 and 3 of 10; 3 makes room for 2 + 2
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]
    assert sorted((offsets[0], offsets[2], offsets[3])) == [0, 6, 8]


def test_packing_wastes_little_and_overlaps_nothing():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 5000), np.clip(rng.lognormal(6, 1, 5000), 1, 2048).astype(int), np.full(100, 2048), np.array([5])):
        bins, offsets = packing.best_two_fit(lengths, 2048)
        assert bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.01 + 1
        for b in np.unique(bins)[:200]:
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert (offsets[at] == np.cumsum(lengths[at]) - lengths[at]).all() and lengths[at].sum() <= 2048


def test_added_tokens_inside_texts_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " two  <|endoftext|><|endoftext|>\n end", "<|endoftext", "<|endoftext |>"]
    docs = edge.docs(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])
    got = {r.doc_id: r.ids for r in packing.pieces(docs, keep_ids=True).collect()}
    assert got == {k: encoder.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    assert got[0] == [64, 50256, 65, 0]


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = edge.docs(spark)
    rows = packing.pieces(docs, keep_ids=True).collect()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for doc_id, text in {r[0]: r[1] for r in edge.ROWS if r[0] not in (None, 9)}.items():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_id[doc_id], key=lambda r: r.piece)
        assert [i for p in parts for i in p.ids] == ids
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert all(p.length == 2048 for p in parts[1:]) and (len(parts) == 1 or len(ids) > 2048)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in parts)
    placed = packing.packed(docs).collect()
    assert len(placed) == len(rows) and packing.packed(edge.empty(spark)).count() == 0
    spans = sorted((r.sequence_id, r.offset, r.length) for r in placed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))
    sequences = packing.sequences(docs.filter("doc_id in (1, 2, 9)")).collect()
    assert sum(len(s.ids) for s in sequences) == sum(r.length for r in placed if r.doc_id in (1, 2, 9))


def test_pieces_of_a_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: encoder.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    got = packing.pieces(docs).collect()
    for r in got:
        part = want[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, want.values()))
