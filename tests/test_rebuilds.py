"""Rebuilds: stored prefixes whose inputs changed, change sets of chunks."""

from pyspark.sql import functions as F

from lectern.operators import context, library
from lectern.session import settle, written


def _library(spark, title="Two"):
    courses = spark.createDataFrame(
        [("a", "One", 60_000, "about one"), ("b", title, 90_000, None), ("c", None, 0, "")],
        "video_id string, title string, duration_ms long, video_summary string",
    )
    chapters = spark.createDataFrame(
        [("a", "a-ch000", 0, "Start", "first", 0, 30_000), ("a", "a-ch001", 1, None, None, 30_000, 60_000), ("b", "b-ch000", 0, "", "", 0, 90_000)],
        "video_id string, chapter_id string, idx long, title string, summary string, start_ms long, end_ms long",
    )
    chunks = spark.createDataFrame(
        [("a", f"a-c{k:04d}", f"a-ch00{k // 3}", k, f"t{k}", "", k * 10_000, "word " * 400, "") for k in range(6)]
        + [("b", "b-c0000", "b-ch000", 0, None, None, 0, "short", None)],
        "video_id string, chunk_id string, parent_id string, idx long, title string, summary string, start_ms long, text string, ocr_text string",
    )
    return courses, chapters, chunks


def test_prefix_is_full_or_outline_by_its_measured_tokens(spark):
    got = {r.video_id: r for r in context.choose_prefixes(*_library(spark), max_tokens=1000).collect()}
    assert [(v, got[v].used_outline) for v in "abc"] == [("a", True), ("b", False), ("c", False)]
    assert got["a"].prefix == (
        "# 课程大纲：One\n总时长：01:00\n\n## 全课摘要\nabout one\n\n## Start　[00:00 - 00:30]\nfirst\n- [00:00] t0\n- [00:10] t1\n- [00:20] t2"
        "\n\n## 第 2 章　[00:30 - 01:00]\n- [00:30] t3\n- [00:40] t4\n- [00:50] t5"
    )
    assert "short" in got["b"].prefix and got["c"].prefix.startswith("# 课程材料：未命名课程")
    cut = {r.video_id: r.prefix for r in context.outline_prefix(*_library(spark), max_chars=40).collect()}
    assert cut["a"].startswith(got["a"].prefix[:40]) and "t5" not in cut["a"]


def test_only_courses_with_new_inputs_are_built(spark):
    stored = settle(context.choose_prefixes(*_library(spark), max_tokens=1000))
    todo, kept = context.stale_prefixes(*_library(spark), stored)
    assert (todo.count(), kept.count()) == (0, 3)
    todo, kept = context.stale_prefixes(*_library(spark, "Renamed"), stored)
    assert [r.video_id for r in todo.collect()] == ["b"] and kept.count() == 2
    # what is stored is taken as it is; a course that is gone is left out
    marked = stored.withColumn("prefix", F.concat(F.lit("stored "), "prefix"))
    courses, chapters, chunks = _library(spark, "Renamed")
    got = {r.video_id: r.prefix[:7] for r in context.choose_prefixes(courses.filter("video_id <> 'c'"), chapters, chunks, marked, max_tokens=1000).collect()}
    assert got == {"a": "stored ", "b": "# 课程材料："}


def test_hashes_tell_nulls_rows_and_copies_apart(spark):
    courses, chapters, chunks = _library(spark)
    base = {r.video_id: r.inputs for r in context.prefix_inputs(courses, chapters, chunks).collect()}
    moved = chunks.withColumns({"title": F.when(F.col("video_id") == "a", F.lit(None)).otherwise(F.col("title")),
                                "summary": F.when(F.col("video_id") == "a", F.col("title")).otherwise(F.col("summary"))})
    other = {r.video_id: r.inputs for r in context.prefix_inputs(courses, chapters, moved).collect()}
    twice = {r.video_id: r.inputs for r in context.prefix_inputs(courses, chapters, chunks.union(chunks).union(chunks)).collect()}
    shuffled = {r.video_id: r.inputs for r in context.prefix_inputs(courses, chapters, chunks.orderBy(F.desc("idx"))).collect()}
    assert base == shuffled and other["a"] != base["a"] and other["b"] == base["b"] and twice["a"] != base["a"]


def test_changes_of_a_rebuild(spark):
    old = spark.createDataFrame([("v", "1", "same"), ("v", "2", "old"), ("v", "3", "gone"), ("v", "5", None)], "video_id string, chunk_id string, text string")
    new = spark.createDataFrame([("v", "1", "same"), ("v", "2", "new"), ("v", "4", ""), ("v", "5", None)], "video_id string, chunk_id string, text string")
    got = {r.chunk_id: r.change for r in library.changes(new, old, "chunk_id", ["text"]).collect()}
    assert got == {"1": "kept", "2": "changed", "3": "gone", "4": "added", "5": "kept"}


def test_texts_meet_only_the_rows_of_a_prefix_that_show(spark, monkeypatch):
    made = {}

    def watched(df, label="table"):
        made[label] = written(df, label)
        return made[label]

    monkeypatch.setattr(context, "written", watched)
    courses = spark.createDataFrame([("v", "T", 1000, "")], "video_id string, title string, duration_ms long, video_summary string")
    chapters = spark.createDataFrame([("v", "x", 0, "one", "", 0)], "video_id string, chapter_id string, idx long, title string, summary string, start_ms long")
    rows = [("v", n, None if n == 1 else n * 1000, None if n == 2 else f"text {n}", "slide\nshown" if n % 2 else "") for n in range(500)]
    chunks = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, text string, ocr_text string")
    got = context.full_prefix(courses, chapters, chunks, 100_000).first()
    assert "\n\n【00:00】\ntext 0\n\n【00:00】\n（课件）slide / shown\ntext 1\n\n【00:02】\n\n【00:03】\n（课件）slide / shown\ntext 3" in got.prefix
    short = context.full_prefix(courses, chapters, chunks, 400).first()
    assert len(short.prefix) > 400 and short.prefix[:50] == got.prefix[:50] and "slide" not in short.prefix
    assert [f.name for f in made["lengths"].schema if f.dataType.simpleString() == "string"] == ["video_id"]
    assert 0 < made["shown"].count() < 60
