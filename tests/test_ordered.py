"""Ordered operators against plain loops, with one key far larger than a block."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import intervals, ordered, segments


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small tables would be merged into one block; here every range keeps its own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def loop_runs(rows, gap_ms, min_span, max_span):
    out, run, first, prev = [], 0, None, None
    for start, end in rows:
        if first is None:
            first = start
        elif (end - first >= min_span and start - prev >= gap_ms) or end - first >= max_span:
            run += 1
            first = start
        prev = end
        out.append(run)
    return out


def transcript(seed, n, dense):
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice((0, 200, 900, 1600, 5000) if dense else (500, 3000, 40_000))
        length = rng.choice((400, 2500, 9000, 120_000) if rng.random() < 0.05 else (400, 2500, 6000))
        rows.append((t, t + length))
        t += rng.choice((0, length))
    return rows


@pytest.mark.parametrize("dense", [True, False])
def test_runs_of_a_hot_course(spark, dense):
    courses = {"hot": transcript(1, 3000, dense), "a": transcript(2, 40, dense), "b": transcript(3, 1, dense), "zz": transcript(4, 700, dense)}
    data = [(c, i, s, e) for c, rows in courses.items() for i, (s, e) in enumerate(rows)]
    random.Random(5).shuffle(data)
    df = spark.createDataFrame(data, "video_id string, idx long, start_ms long, end_ms long")
    for gap, low, high in ((1500, 30_000, 90_000), (6000, 0, 600_000)):
        got = ordered.cut_runs(df, "video_id", ["start_ms", "idx"], gap_ms=gap, min_span=low, max_span=high).toPandas()
        for c, rows in courses.items():
            mine = got[got.video_id == c].sort_values(["start_ms", "idx"])["run"].tolist()
            assert mine == loop_runs(rows, gap, low, high), c


def test_leaves_of_a_dense_block():
    n = 100_000
    starts = list(range(n))
    assert ordered._leaves(starts, [float("-inf")] + [s - 10 * n for s in starts[1:]]) == [(s, 0) for s in starts]
    rng = random.Random(6)
    starts = sorted(rng.randrange(5000) for _ in range(600))
    limits = [float("-inf")] + [s - rng.randrange(-20, 400) for s in starts[1:]]

    def leave(at):
        cut = next((k for k in range(at + 1, len(starts)) if limits[k] >= starts[at]), None)
        if cut is None:
            return starts[at], 0
        final, cuts = leave(cut)
        return final, cuts + 1

    assert ordered._leaves(starts, limits) == [leave(i) for i in range(600)]


def test_hot_course_is_spread(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    sizes = ordered.blocks(df, ["k"], ["o"]).groupBy(ordered.BLOCK).count().toPandas()["count"]
    assert len(sizes) > 1 and sizes.max() < 4000


def test_prefix_both_ways(spark):
    rng = random.Random(7)
    data = [(rng.choice("aaaab"), i, rng.choice((None, rng.randint(0, 99)))) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    b = ordered.blocks(df, ["k"], ["o"])
    out = ordered.prefix(b, ["k"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("count", F.lit(1))})
    out = ordered.prefix(out, ["k"], ["o"], {"nx": ("last", F.col("v"))}, backwards=True).toPandas()
    for _k, g in pd.DataFrame(data, columns=["k", "o", "v"]).groupby("k"):
        g = g.sort_values("o")
        mine = out[out.k == g.k.iat[0]].sort_values("o")
        seen = g.v.shift().fillna(0).cumsum().tolist()
        assert mine.s.fillna(0).tolist() == seen
        assert mine.n.tolist() == list(range(len(g)))
        assert mine.l.fillna(-1).tolist() == g.v.ffill().shift().fillna(-1).tolist()
        assert mine.nx.fillna(-1).tolist() == g.v.bfill().shift(-1).fillna(-1).tolist()
        assert mine.m.fillna(-1).tolist() == g.v.fillna(-1).cummax().shift().fillna(-1).tolist()


def test_chunk_fixture(spark):
    df = spark.createDataFrame(
        [("v", 0, 0, 20_000, "a", None), ("v", 1, 21_000, 40_000, "b", "2"), ("v", 2, 60_000, 80_000, "c", "1")],
        "video_id string, idx long, start_ms long, end_ms long, text string, speaker string",
    )
    rows = segments.build_chunks(df).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.chunk_id) for r in rows] == [(0, 40_000, "a\n[2] b", "v-c0000"), (60_000, 80_000, "c", "v-c0001")]


def test_slides_attach_by_strict_overlap(spark):
    chunks = spark.createDataFrame([("v", "c0", 0, 30_000), ("v", "c1", 45_000, 75_000)], "video_id string, chunk_id string, start_ms long, end_ms long")
    slides = spark.createDataFrame([("v", 0, 0, 31_000, "x"), ("v", 1, 31_000, 60_000, "y")], "video_id string, slide_id long, start_ms long, end_ms long, ocr_text string")
    got = {r.chunk_id: (r.slide_idxs, r.ocr_text) for r in segments.attach_slides(chunks, slides).collect()}
    assert got == {"c0": ([0], "x"), "c1": ([1], "y")}


def test_nearest_span_with_overlaps_and_ties(spark):
    rng = random.Random(11)
    spans = [("a" if i % 5 else "b", i, s := rng.randrange(0, 400_000, 500), s + rng.randrange(0, 130_000)) for i in range(60)]
    points = [(i, rng.choice("abc"), rng.randrange(-1000, 600_000, 250)) for i in range(200)]
    s = spark.createDataFrame(spans, "k string, idx long, start_ms long, end_ms long")
    p = spark.createDataFrame(points, "pid long, k string, at long")
    got = {r.pid: (r.idx, r.distance) for r in intervals.nearest_span(p, s, "k", point_id=["pid"], at="at", span=("start_ms", "end_ms"), idx="idx").collect()}
    assert len(got) == len(points)
    for pid, k, at in points:
        mine = [(0 if b <= at <= e else abs(b - at), i) for kk, i, b, e in spans if kk == k]
        assert got[pid] == ((min(mine)[1], min(mine)[0]) if mine else (None, None))


def test_overlap_and_tolerance(spark):
    rng = random.Random(13)
    a = [(i, s := rng.randrange(0, 500_000), s + rng.randrange(1, 200_000)) for i in range(50)]
    b = [(i, s := rng.randrange(0, 500_000), s + rng.randrange(1, 90_000)) for i in range(50)]
    l = spark.createDataFrame(a, "i long, s long, e long").withColumn("k", F.lit(1))
    r = spark.createDataFrame(b, "j long, rs long, re long").withColumn("k", F.lit(1))
    got = sorted((x.i, x.j) for x in intervals.overlap_join(l, r, ["k"], left_span=("s", "e"), right_span=("rs", "re")).collect())
    assert got == sorted((i, j) for i, s, e in a for j, rs, re in b if s < re and rs < e)
    near = intervals.tolerance_semi(l, r, ["k"], at="s", anchor="rs", tolerance=3000).collect()
    assert sorted(x.i for x in near) == sorted(i for i, s, _ in a if any(abs(rs - s) <= 3000 for _, rs, _ in b))


def test_stitch_keeps_strictly_increasing_ends(spark):
    data = [("v", 0, 0, 0, 0, 1000), ("v", 0, 0, 1, 900, 2500), ("v", 1, 2000, 0, 0, 400), ("v", 1, 2000, 1, 300, 900)]
    df = spark.createDataFrame(data, "video_id string, span_no long, span_start long, pos long, start_ms long, end_ms long")
    rows = segments.stitch(df).orderBy("end_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 1000), (900, 2500), (2300, 2900)]
