"""What shows only on larger tables: tables of many files, chapters whose names meet, letters beside accents."""

import collections
import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import glossary
from lectern.schemas import TABLES

duckdb = pytest.importorskip("duckdb")


def same_rows(spark, folder, name):
    """The query's rows, after a comparison with its SQL over the tables in ``folder``."""
    con = duckdb.connect()
    for table in TABLES:
        path = pathlib.Path(folder, f"{table}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    rows = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    assert collections.Counter(rows) == collections.Counter(con.sql(entry.oracle_sql()[name]).fetchall())
    return rows


@pytest.mark.parametrize("name", ["stream_sessions", "stream_replies"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    n = F.col("id")
    talk = spark.range(280).select((n % 70).alias("conv_id"), F.floor(n / 70).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("a b "), n).alias("text"))
    # the newest conversations in the first files
    talk.repartitionByRange(70, F.desc("conv_id")).write.parquet(f"{tmp_path}/conversations.parquet")
    assert len(same_rows(spark, tmp_path, name)) > 60


def test_sentences_pass_with_the_second_they_start_in(spark, tmp_path):
    # the newest event is at 12:00:00.300: user 1 starts a chunk in the second of the watermark, user 2 has been idle just long enough
    at = lambda user, *times: [(user, f"2024-01-01 {t}") for t in times]
    rows = at(1, "00:00:00.1", "11:50:00.9", "11:51:00.2") + at(2, "01:00:00.5", "11:40:00.3") + at(3, "02:00:00", "11:40:00.4")
    rows += at(4, "03:00:00", "11:50:01.0") + at(9, "04:00:00", "12:00:00.3")
    events = spark.createDataFrame([(k, u, ts) for k, (u, ts) in enumerate(rows)], "event_id long, user_id long, ts string")
    events = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {(r[0], r[1]) for r in same_rows(spark, tmp_path, "stream_chunks")} >= {("u1", 0), ("u2", 0)}


def test_letters_beside_accents_and_tabs(spark):
    texts = spark.createDataFrame([("caña b c d", ), ("x y\x0bz w v", ), ("_a b c 1a b c", ), ("a b cé", )], "t string")
    found = [r[0] for r in texts.select(glossary.spaced_letters(F.col("t"))).collect()]
    assert found == [["a b c d"], ["z w v"], [], ["a b c"]]


@pytest.mark.parametrize("name", ["chapter_members", "outline_prefix", "notes_document", "notes_stored"])
def test_chapters_that_share_a_name(spark, tmp_path, name):
    n = F.col("id")
    body = F.concat(F.lit("title "), n, F.lit("\nword and more\nrest"))
    # chapters 100 and 1000 to 1003 have one name, and so have 0 and none other
    ids = spark.range(3).union(spark.range(10_000, 10_003)).union(spark.range(100_000, 100_400, 50))
    ids.select(n.alias("doc_id"), body.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length(body).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = same_rows(spark, tmp_path, name)
    assert ("src1-ch100", 55, "src1-c10000") in rows or name != "chapter_members"


def documents(spark, folder, texts):
    """A documents table of these texts, each in an even and an odd row."""
    rows = [(2 * k + odd, text, "en", "src1", len(text or "")) for k, text in enumerate(texts) for odd in (0, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_findings_read_a_note_once(spark, tmp_path, monkeypatch):
    from lectern.plans import notes

    n = F.col("id")
    body = F.concat(F.lit("title "), n % 3, F.lit("\nword a b c d \"some quoted phrase\" here\nmy_name my_nane v1.2 end "), F.repeat(F.lit("long text "), F.lit(500)))
    ids = spark.range(3).union(spark.range(10_000, 10_003)).union(spark.range(100_000, 101_000, 25))
    ids.select(n.alias("doc_id"), body.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), n % 2).alias("source"), F.length(body).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    talk = [(k, turn, "user", f"said {k}\nand {turn}") for k in range(4) for turn in range(3)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "a long title word")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, written = [], notes.written

    def counted(df, *label, **how):
        out = written(df, *label, **how)
        sizes.append(out.agg(F.sum(F.length("text" if "text" in out.columns else out.columns[-1]))).first()[0])
        return out

    monkeypatch.setattr(notes, "written", counted)
    rows = same_rows(spark, tmp_path, "notes_complete")
    shown = sum(len(r[3]) for r in rows)
    # chapters 100 and 1000 to 1009 of a course hold the same note: it is looked through once
    assert max(sizes) < shown / 4


def test_texts_without_a_repeated_heading_stay_as_they_are(spark, tmp_path):
    documents(spark, tmp_path, ["", None, "  ", "\n \n", "\t", "a b\t", "\ta\nb", "a\x0bb\r\nc\rd", "a\u2028b \u00a0", "# x\n\ny", "## 1. title x\n\nagain"])
    rows = dict(same_rows(spark, tmp_path, "strip_heading"))
    assert rows[0] == "" and rows[1] == "# other\n"


def test_blank_documents_have_no_sections(spark, tmp_path):
    texts = ["", None, "  ", "\n \n", "a\nb", "#### deep", "#one\ntwo", "a\nb\nc\n\nd\n\n\n\ne", "a\nb\nc\n \ne", "#\n##\n# \n#x", "x\u2028y", "a\u2029# b\nc\nd\ne", "text\n# one\n\n### x"]
    documents(spark, tmp_path, texts)
    rows = same_rows(spark, tmp_path, "doc_sections")
    assert min(r[0] for r in rows) == 8 and (14, 0, "导言", "a\n\nb\n\nc\n\n##") not in rows


def test_answered_questions_need_no_scores(spark):
    from lectern.operators import retrieval

    docs = spark.createDataFrame([("a", f"a{k}", "common word") for k in range(50)] + [("b", "b0", "other")], "video_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "a", "common"), (1, "a", "word"), (2, "a", "other"), (3, "b", "other"), (4, "c", "common")], "qid long, video_id string, term string")
    found = retrieval.answered(docs, asked)
    assert sorted(r.qid for r in found.collect()) == [1, 3]
    assert {r.qid for r in retrieval.keyword_hits(docs, asked, 32).collect()} == {1, 3}


def test_first_places_are_found_without_their_lines(spark):
    from lectern.operators import notes

    rows = [("a", 1, 0, 5, "x", "course", None), ("a", 0, 10**9, 7, "x", "late", 9), ("a", 0, 3, 12, "x", "first", 3), ("a", 0, 3, 12, "y", "first", 3),
            (None, 1, 0, 1, "x", None, None)]
    table = spark.createDataFrame(rows, "video_id string, source int, idx long, pos long, term string, definition string, start_ms long")
    merged = notes.merge_concepts(table)
    assert {tuple(r) for r in merged.collect()} == {("a", "x", "first", 3, (0, 3, 12)), ("a", "y", "first", 3, (0, 3, 12)), (None, "x", None, None, (1, 0, 1))}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
