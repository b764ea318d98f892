"""Literal cases: guides, contexts, replies, usage summary, course lookup, live chunks."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.operators import glossary, ledger, library, notes
from lectern.session import written
from lectern.streaming import jobs


def test_guides_without_a_time_line_become_empty(spark):
    guides = spark.createDataFrame(
        [(1, "a", "no time at all"), (2, "a", "good\n> 时间 01:00\nbad\n> 时间 59:00\ntail"), (3, "b", "two\n> 时间 01:00、02:00")],
        "gid long, video_id string, text string",
    )
    anchors = spark.createDataFrame([("a", 60_000), ("b", 120_000)], "video_id string, start_ms long")
    got = {r.gid: (r.text, r.kept, r.dropped) for r in notes.verify_guides(guides, anchors).collect()}
    assert got == {1: ("", 0, 0), 2: ("good\n> 时间 01:00", 1, 1), 3: ("two\n> 时间 02:00", 1, 0)}


def test_contexts_read_summary_and_text_chunk_by_chunk(spark):
    rows = [("v", 1, 3, 3, i, "summary", i * 1000, f"s{i} term", False) for i in range(5)]
    rows += [("v", 1, 3, 4, i, "text", i * 1000, f"t{i} term", True) for i in range(5)]
    rows += [("v", 0, 0, 0, 9, "slide", 9000, "term on a slide", True), ("v", 2, 5, 6, 0, "said", 0, "u term", True)]
    sources = spark.createDataFrame(
        rows, "video_id string, priority int, grp int, source_no int, idx long, label string, ms long, text string, trusted boolean"
    )
    terms = spark.createDataFrame([("v", "term")], "video_id string, term string")
    best = glossary.best_contexts(glossary.contexts(sources, terms)).orderBy("rank").collect()
    assert [r.line.split("…")[1] for r in best] == ["term on a slide", "s0 term", "t0 term", "s1 term", "t1 term", "s2 term", "t2 term", "s3 term"]


def test_first_object_of_a_list_is_taken(spark):
    cases = ['{"a": 1}', '[{"a": 1}, {"a": 2}]', '[1, "{x}", [2], {"a": 3}]', "[1, 2]", '"text"', None]
    got = [r.o for r in spark.createDataFrame([(c,) for c in cases], "j string").select(replies.as_object(F.col("j")).alias("o")).collect()]
    assert [g and g.replace(" ", "") for g in got] == ['{"a":1}', '{"a":1}', '{"a":3}', None, None, None]


def test_usage_summary_lists_every_course(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("c1", "m", "chat", at, 1.5), ("c2", "m", "chat", at, None), ("gone", "m", "chat", at, 0.0)]
    rows += [("c1", "m", "chat", at + datetime.timedelta(days=d), 0.1) for d in range(1, 40)]
    usage = spark.createDataFrame(rows, "video_id string, model string, kind string, at timestamp_ntz, cost double")
    for c in ("prompt_tokens", "cached_tokens", "completion_tokens", "audio_ms"):
        usage = usage.withColumn(c, F.lit(1).cast("long"))
    courses = spark.createDataFrame([("c1", "One"), ("c2", "")], "video_id string, title string")
    labels = spark.createDataFrame([("gone", "Old")], "video_id string, title string")
    got = ledger.summary(usage, courses, labels).collect()
    of_courses = {r.name: (r.title, r.deleted, r.calls, round(r.cost, 6), r.unpriced) for r in got if r.level == "course"}
    assert of_courses == {"c1": ("One", False, 40, 5.4, 0), "c2": ("c2", False, 1, 0.0, 1), "gone": ("已删除 · Old", True, 1, 0.0, 0)}
    days = sorted(r.name for r in got if r.level == "day")
    assert len(days) == 30 and days[0] == "2024-01-11" and days[-1] == "2024-02-09"


def test_course_lookup_by_the_rarest_piece(spark):
    courses = spark.createDataFrame(
        [(f"v{k}", f"p{k}.mp4", f"Course about topic {k:04d}") for k in range(500)], "video_id string, path string, title string"
    )
    wanted = spark.createDataFrame([("v7",), ("p8.mp4",), ("TOPIC 0123",), ("Course",), ("to",), ("xyz",), ("topic 9",)], "token string")
    got = {r.token: (r.video_id, r.matches) for r in library.find_course(courses, wanted).collect()}
    assert got == {"v7": ("v7", 1), "p8.mp4": ("v8", 1), "TOPIC 0123": ("v123", 1), "Course": ("v0", 500), "to": ("v0", 500)}


def test_large_courses_are_written_by_ranges(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "big").otherwise("small").alias("video_id"), F.col("id").alias("idx"))
    library.write_courses(rows, str(tmp_path / "t"), rows_per_file=500)
    library.write_courses(rows.filter("video_id = 'small' and idx < 2500"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).groupBy("video_id").count().collect()
    assert {r.video_id: r["count"] for r in back} == {"big": 2000, "small": 500}
    assert len(list((tmp_path / "t" / "video_id=big").glob("*.parquet"))) >= 4


def test_live_chunks_go_on_after_an_idle_close(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    line = lambda n, course, seconds: (course, start + datetime.timedelta(seconds=seconds), seconds * 1000, seconds * 1000 + 5000, n)
    files = [
        [line(1, "a", 0), line(2, "a", 10), line(3, "b", 20)],
        [line(4, "a", 7000)],  # b and a fall idle
        [line(5, "b", 6800), line(6, "a", 7010)],  # behind the newest row, but within the delay
        [line(7, "c", 20_000)],
        [line(8, "c", 20_010)],
    ]
    schema = "video_id string, at timestamp, start_ms long, end_ms long, seg_id long"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.live_chunks(source, idle_ms=600_000)
    job = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(
        availableNow=True
    ).start(str(tmp_path / "out"))
    job.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 0, 0, 15_000, 2), ("a", 1, 7_000_000, 7_015_000, 2), ("b", 0, 20_000, 25_000, 1), ("b", 1, 6_800_000, 6_805_000, 1)]


def test_live_chunks_of_files_in_any_order_are_those_of_the_batch(spark, tmp_path):
    import random

    from lectern.operators import segments

    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for course in "abc":
        ms = 0
        for n in range(60):
            length = rng.randrange(500, 9000)
            rows.append((course, ms, ms + length, n))
            ms += length + rng.choice([0, 100, 1600, 4000])
    # a sentence comes up to four minutes after its time, in files of two minutes: within the delay of seven minutes
    files = {}
    for course, s, e, n in rows:
        files.setdefault((s + rng.randrange(240_000)) // 120_000, []).append((course, start + datetime.timedelta(milliseconds=s), s, e, n))
    assert any([r[2] for r in f] != sorted(r[2] for r in f) for f in files.values())
    files[99] = [("z", start + datetime.timedelta(hours=2), 7_200_000, 7_201_000, 1)]
    files[100] = [("z", start + datetime.timedelta(hours=2, minutes=1), 7_260_000, 7_261_000, 2)]
    schema = "video_id string, at timestamp, start_ms long, end_ms long, seg_id long"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for k in sorted(files):
        rng.shuffle(files[k])
        spark.createDataFrame(files[k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{k:03d}"))
    out = jobs.live_chunks(source, late="7 minutes")
    job = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(
        availableNow=True
    ).start(str(tmp_path / "out"))
    job.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()))
    batch = spark.createDataFrame([(*r, "t", "") for r in rows], "video_id string, start_ms long, end_ms long, idx long, text string, speaker string")
    want = segments.build_chunks(batch).select("video_id", "idx", "start_ms", "end_ms", "n_segments")
    assert got == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        jobs.live_chunks(source, idle_ms=1000)


def test_slides_of_a_long_course_match_a_loop(spark):
    import random

    import numpy as np

    from lectern.operators import media

    rng = random.Random(3)
    rows = []
    for course, n in (("long", 700), ("short", 9), ("still", 200)):
        level = 100.0
        for k in range(n):
            if course != "still" and rng.random() < 0.15:
                level = rng.choice([80.0, 90.0, 100.0, 104.0, 120.0])
            rows.append((course, k * 2000 + rng.randrange(3), [level + rng.random() for _ in range(4)]))
    want = {}
    for course in ("long", "short", "still"):
        mine = [r for r in rows if r[0] == course]
        grp, first = 0, mine[0]
        for r in mine:
            if np.abs(np.array(r[2]) - np.array(first[2])).mean() / 255 > 0.02 or r[1] - first[1] > 120_000:
                grp, first = grp + 1, r
            want[course, r[1]] = grp
    frames = spark.createDataFrame(rows, "video_id string, ms long, gray array<double>")
    for merged in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        spark.conf.set("spark.sql.shuffle.partitions", "4" if merged == "true" else "40")
        got = {(r.video_id, r.ms): r.grp for r in media.frame_groups(frames, change_ratio=0.02, max_hold_ms=120_000).collect()}
        assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.grp for r in media.frame_groups(frames, max_groups=2).collect()} == {0, 1}


def test_budgets_with_one_large_course(spark):
    from lectern.operators import context

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("big", k, "x" * (k % 7 + 1)) for k in range(4000)] + [("small", k, "y" * 5) for k in range(3)]
    blocks = spark.createDataFrame(rows, "video_id string, idx long, block string")
    got = context.prefix_take(blocks, "video_id", "idx", F.length("block"), 1000).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, used = set(), 0
    for v, k, b in rows:
        if v == "big" and used + len(b) <= 1000:
            used += len(b)
            want.add((v, k))
        elif v == "big":
            break
    assert {(r.video_id, r.idx) for r in got} == want | {("small", 0), ("small", 1), ("small", 2)}


def test_document_with_guide_and_findings(spark):
    from lectern.operators import notes

    courses = spark.createDataFrame([("a", "T", 60_000), ("b", "", 1000)], "video_id string, title string, duration_ms long")
    chapters = spark.createDataFrame([("a", "a-0", 0, "eins", "kurz", 0, 30_000), ("a", "a-1", 1, "", "", 30_000, 60_000)], "video_id string, chapter_id string, idx long, title string, summary string, start_ms long, end_ms long")
    said = spark.createDataFrame([("a-0", 'D Y L and "some | word" or "some | word" x|y jeb_wincon_a'), ("a-1", "jeb_winco_a x|y, a thing")], "chapter_id string, note string")
    terms = spark.createDataFrame([], "video_id string, rank long, term string, definition string")
    guides = spark.createDataFrame([("a", "read this", 1), ("b", "no chapters", 1)], "video_id string, text string, kept long")
    rows = notes.document_rows(courses, chapters, said, terms, guides)
    listed = spark.createDataFrame([("x|y",), ("wincon",), ("absent",)], "term string")
    got = {(r.video_id, r.part, r.idx): r.text for r in notes.with_findings(rows, listed).collect()}
    assert got["a", 0, 1] == "\n## 学习导读\n\nread this" and ("b", 0, 1) not in got
    found = [got[k] for k in sorted(got) if k[1] == 4 and k[2] > 0]
    # a listed term inside another finding is no finding of its own; "some | word" is no quoted phrase (a bar is not part of one)
    assert [f.split(" | ")[0::3] for f in found] == [["| `D Y L`", "1 |"], ["| `jeb_wincon_a / jeb_winco_a`", "2 |"], ["| `x\\|y`", "2 |"]]
    assert [k for k in got if k[0] == "b"] == [("b", 0, 0)]
    again = notes.document_rows(courses, chapters, said, terms, guides.withColumn("kept", F.lit(0).cast("long")))
    assert again.filter("part = 0 AND idx = 1").isEmpty()


def test_documents_are_not_replaced_by_failed_ones(spark, tmp_path):
    folder = str(tmp_path / "notes")
    rows = lambda *of: spark.createDataFrame([(v, 0, k, f"{text} {k}") for v, text in of for k in range(3)], "video_id string, part int, idx long, text string")
    failed = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "video_id string, degraded boolean")
    read = lambda version="now": {r.video_id: r.text for r in notes.read_documents(spark, folder, version).filter("idx = 2").collect()}
    assert read() == {}
    notes.write_documents(rows(("a", "one"), ("b", "one")), folder, failed)
    assert read() == {"a": "one 2", "b": "one 2"} and read("previous") == {}  # a first document is written in any case
    notes.write_documents(rows(("a", "two"), ("b", "two"), ("c", "two")), folder, failed)
    assert read() == {"a": "one 2", "b": "two 2", "c": "two 2"} and read("previous") == {"b": "one 2"}
    notes.write_documents(rows(("a", "three")), folder, failed, force=True)
    assert read() == {"a": "three 2", "b": "two 2", "c": "two 2"} and read("previous") == {"a": "one 2", "b": "one 2"}


def test_concepts_and_outcomes_are_written(spark, tmp_path):
    from lectern.operators import evaluation

    said = [("a", 0, k, 0, f"t{k % 40}", f"d{k}", 1000 * k) for k in range(100)] + [("b", 1, 0, 0, "only", "one", None)]
    merged = notes.merge_concepts(spark.createDataFrame(said, "video_id string, source int, idx long, pos int, term string, definition string, start_ms long"))
    notes.write_concepts(merged, str(tmp_path / "concepts"))
    lines = spark.read.text(str(tmp_path / "concepts")).collect()
    assert sorted(r.value for r in lines if r.video_id == "a") == sorted(f"- **t{k}**（00:{k:02d}）：d{k}" for k in range(40))
    assert [r.value for r in lines if r.video_id == "b"] == ["- **only**（00:00）：one"]
    outcomes = spark.createDataFrame([(k, "factual", k / 10, ("ok", "missing", "wrong")[k % 3], k == 5) for k in range(6)], "qid int, type string, score double, status string, failed boolean")
    evaluation.write_outcomes(outcomes, str(tmp_path / "run"))
    back = spark.read.json(str(tmp_path / "run" / "answers"))
    assert sorted((r.qid, r.status, r.failed) for r in back.collect()) == [(k, ("ok", "missing", "wrong")[k % 3], k == 5) for k in range(6)]
    totals = spark.read.json(str(tmp_path / "run" / "summary")).first()
    assert (totals.n, totals["mean"], totals.failures) == (6, 0.25, 1)


def test_words_of_a_course_are_split_once(spark, monkeypatch):
    labels = []

    def watched(df, label="table"):
        labels.append(label)
        return written(df, label)

    monkeypatch.setattr(notes, "written", watched)
    guides = spark.createDataFrame([(1, "v", "needle Hay missing `a b` `c d`"), (2, "w", "needle")], "gid long, video_id string, text string")
    chunks = spark.createDataFrame([("v", "Needles in hay"), ("v", "A B"), ("w", None)], "video_id string, text string")
    got = notes.unverified_terms(guides, chunks)
    assert sorted((r.gid, r.term) for r in got.collect()) == [(1, "c d"), (1, "missing"), (2, "needle")]
    assert labels == ["words"] and "array_distinct(split" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_corrected_once_when_only_corrected_ones_are_asked_for(spark):
    rows = spark.createDataFrame([("v", 1, "fo bar", None), ("v", 2, "clean", "t"), ("w", 3, None, "fo fo")], "video_id string, idx long, text string, title string")
    rules = spark.createDataFrame([("", ["fo"], "foo!", "", 1)], "video_id string, wrong array<string>, right string, reason string, ord long")
    done = glossary.repair(rows, rules, ["text", "title"])
    touched = done.filter(glossary.n_fixes(F.col("fixes_text")) + glossary.n_fixes(F.col("fixes_title")) > 0).select("idx", "text", "title")
    assert sorted(map(tuple, touched.collect())) == [(1, "foo! bar", ""), (3, "", "foo! foo!")]
    plan = touched._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "replace(" in line]
