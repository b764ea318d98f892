"""Source divergence against a loop over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import divergence
from tests.llm import edge

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, top):
    """rows: (lang, source, text)"""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(_lower))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        of = {s: c for (la, s), c in groups.items() if la == lang}
        whole = sum((Counter({t: c[t] for t in kept}) for c in of.values()), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        ps, q = {s: p_of(c) for s, c in of.items()}, p_of(whole)
        for s in of:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if of[s][t] > 0 and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("tile", [2, 64])
def test_equals_a_loop(spark, tile):
    rng = random.Random(3)
    names = [f"w{a}{b}é" for a in "abcdefghijklmnopqrstuvwxyzäöü" for b in "abcdefghijklmnopqrstuvwxyz" for _ in (0,)]
    names += [n.upper().replace("É", "x") for n in names]
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(6)}" if k % 7 else None
        weights = rng.choices(names, k=rng.randrange(0, 120)) + ["The"] * rng.randrange(9) + ["the"]
        rows.append((("en", "de", None)[k % 3], source, "-1 ".join(weights) if k % 11 else None))
    rows += [("xx", "a", "seldom"), ("xx", "b", None)]
    table = spark.createDataFrame([(k, *r, 1, 2) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, p int, n int")
    assert got(divergence.audit(table.repartition(5), 3, 4, tile)) == brute(rows, 3, 4)


def test_edge_rows(spark):
    rows = [(r[2], r[3], r[1]) for r in edge.ROWS]
    assert got(divergence.audit(edge.docs(spark), 2, 10)) == brute(rows, 2, 10)
    assert got(divergence.audit(edge.docs(spark), 10, 10)) == brute(rows, 10, 10)
    assert divergence.audit(edge.empty(spark)).collect() == []


def test_long_texts_are_counted_in_pieces():
    raw = " ".join(f"ab{'c' * (k % 7)}" for k in range(5000)).encode()
    old = divergence.PIECE
    try:
        divergence.PIECE = 100
        assert [w for part in divergence._pieces(raw) for w in part] == raw.split()
    finally:
        divergence.PIECE = old
