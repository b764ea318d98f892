"""Time joins over spans of very different lengths against loops."""

import random

from pyspark.sql import functions as F

from lectern.operators import intervals

YEAR = 365 * 86_400_000


def spans(rng, n, tag):
    out = []
    for k in range(n):
        start = rng.randrange(-YEAR, 3 * YEAR)
        length = rng.choice([0, 1, 999, 60_000, 16 * 60_000, 16 * 60_000 + 1, 10**7, 10**9, YEAR, 40 * YEAR, -5])
        out.append((f"k{rng.randrange(3)}", f"{tag}{k}", start, start + length))
    return out


def test_overlap_and_stab_equal_loops(spark):
    rng = random.Random(7)
    left, right = spans(rng, 250, "a"), spans(rng, 250, "b")
    right += [(v, f"{i}near", s + 30_000, e + 30_000) for v, i, s, e in left[:60]]
    a = spark.createDataFrame(left, "k string, i string, s long, e long")
    b = spark.createDataFrame(right, "k string, j string, rs long, re long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["k"], left_span=("s", "e"), right_span=("rs", "re")).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]) and len(got) > 3000
    points = spark.createDataFrame([(v, i, s) for v, i, s, _ in left], "k string, i string, at long")
    got = sorted((r.i, r.j) for r in intervals.stab_join(points, b, ["k"], at="at", span=("rs", "re")).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and y[2] <= x[2] <= y[3]) and len(got) > 1000


def test_long_spans_make_few_rows(spark):
    rows = spark.createDataFrame([(0, 1), (5, YEAR), (7, 40 * YEAR), (123, 60_123)], "s long, e long")
    made = intervals._on_levels(rows, "s", "e", intervals.BIN_MS, "_l").groupBy("s").agg(F.count("*").alias("n"))
    assert all(r.n < 60 for r in made.collect())
