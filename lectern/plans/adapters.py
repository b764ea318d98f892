"""Spark side of the adapters over the shared tables (SQL side: ``views.py``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text
from lectern.operators import ledger, ordered, segments as seg


def course_of(number: Column) -> Column:
    return F.concat(F.lit("src"), (number % 20).cast("string"))


def padded(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def calls(t) -> DataFrame:
    """events as model calls"""
    n = F.col("event_id")
    tokens = F.floor(F.col("value") * 100)
    return t.events.select(
        "event_id",
        F.col("ts").alias("at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
        F.col("event_type").alias("kind"),
        F.when(n % 3 == 0, "deepseek-flash").when(n % 3 == 1, "deepseek-v4-pro").otherwise("local-model").alias("model"),
        tokens.cast("long").alias("prompt_tokens"),
        F.floor((n % 120) * tokens / 100).cast("long").alias("cached_tokens"),
        ((n % 50) * 10).cast("long").alias("completion_tokens"),
        F.floor(F.col("value") * 1000).cast("long").alias("audio_ms"),
    )


def usage(t) -> DataFrame:
    return ledger.price_calls(calls(t))


def segments(t) -> DataFrame:
    """events as transcript sentences; epoch seconds stand for milliseconds"""
    start = clock.epoch_seconds(F.col("ts"))
    return t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
        F.col("event_id").alias("seg_id"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100).cast("long")).alias("end_ms"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        (F.col("event_id") % 4).cast("string").alias("speaker"),
    )


def numbered_segments(t) -> DataFrame:
    order = ["start_ms", "seg_id"]
    return ordered.prefix(
        ordered.blocks(segments(t), ["video_id"], order), ["video_id"], order,
        {"idx": ("count", F.lit(1))},
    ).drop(ordered.BLOCK)


def slides(t) -> DataFrame:
    """view events as slides, each shown until the next one"""
    views = segments(t).filter(F.col("text").startswith("view "))
    order = ["start_ms", "seg_id"]
    return ordered.prefix(
        ordered.blocks(views, ["video_id"], order), ["video_id"], order,
        {"_next": ("last", F.col("start_ms"))}, backwards=True,
    ).select(
        "video_id",
        F.col("seg_id").alias("slide_id"),
        "start_ms",
        F.coalesce("_next", F.col("start_ms") + 1000).alias("end_ms"),
        F.concat(F.lit("slide "), "text").alias("ocr_text"),
    )


def transcript_chunks(t) -> DataFrame:
    return seg.build_chunks(segments(t), order=["start_ms", "seg_id"])


def transcript_chapters(t, chunks: DataFrame | None = None) -> DataFrame:
    """chunks -> chapters; the adapter's axis is coarse, so the limits are scaled"""
    chunks = transcript_chunks(t) if chunks is None else chunks
    return seg.build_chapters(chunks, gap_ms=60_000, max_span=600_000)


def docs(t) -> DataFrame:
    """documents as chunks, course = source"""
    n = F.col("doc_id")
    rows = F.split("text", "\n")
    start = n * 120_000
    span = F.greatest(F.lit(1000), 5 * F.length("text"))
    return t.documents.select(
        F.col("source").alias("video_id"),
        n.alias("idx"),
        F.concat_ws("-c", "source", padded(n, 4)).alias("chunk_id"),
        start.alias("start_ms"),
        (start + span).alias("end_ms"),
        "text",
        "lang",
        F.get(rows, F.lit(0)).alias("title"),
        F.coalesce(F.get(rows, F.lit(1)), F.lit("")).alias("summary"),
        F.when(n % 3 == 0, "").otherwise(F.coalesce(F.get(rows, F.lit(2)), F.lit(""))).alias("ocr_text"),
        F.concat_ws("-ch", "source", F.lpad(F.floor(n / 100).cast("string"), 3, "0")).alias("parent_id"),
        F.floor(n / 100).alias("chapter_idx"),
    )


def doc_chapters(t) -> DataFrame:
    return (
        docs(t)
        .groupBy("video_id", F.col("parent_id").alias("chapter_id"), F.col("chapter_idx").alias("idx"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.min_by("title", docs_idx()).alias("_title"),
            F.min_by("summary", docs_idx()).alias("summary"),
        )
        .withColumn("title", F.when(F.col("idx") % 2 == 0, F.col("_title")).otherwise(""))
        .drop("_title")
    )


def numbered_chapters(t) -> tuple[DataFrame, DataFrame]:
    """chapters and chunks that meet by chapter number: their names are cut to three digits, so from the thousandth chapter of a
    course on several have the same; it stays as ``name``"""
    number = lambda n: F.concat_ws("#", "video_id", F.col(n).cast("string"))
    chapters = doc_chapters(t).withColumn("name", F.col("chapter_id")).withColumn("chapter_id", number("idx"))
    return chapters, docs(t).withColumn("parent_id", number("chapter_idx"))


def docs_idx() -> Column:
    # the document number inside the aggregate above, where ``idx`` already names the chapter
    return F.col("start_ms")


def questions(t) -> DataFrame:
    """one search question per benchmark item: all its words, asked in one course"""
    qid = F.col("item_id")
    return t.benchmark.select(
        qid.alias("qid"), course_of(qid).alias("video_id"), F.explode(text.query_terms(F.col("text"))).alias("term")
    )


def question_vectors(t) -> DataFrame:
    return t.benchmark.select(
        F.col("item_id").alias("qid"), course_of(F.col("item_id")).alias("video_id")
    ).join(t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")


def vectors(t) -> DataFrame:
    keys = docs(t).select("idx", "video_id", "chunk_id")
    return t.embeddings.select(
        F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), "label"
    ).join(keys, "idx")


def messages(t) -> DataFrame:
    conv = F.col("conv_id")
    return t.conversations.select(
        conv.alias("session_id"),
        (conv * 100 + F.col("turn")).alias("id"),
        "role",
        F.col("text").alias("content"),
        course_of(conv).alias("video_id"),
        (conv * 86400 + F.col("turn") * 60).alias("created_s"),
    )


def sessions(t) -> DataFrame:
    sid = F.col("session_id")
    return (
        messages(t)
        .groupBy("session_id", "video_id")
        .agg(F.min("created_s").alias("created_s"), F.max("created_s").alias("updated_s"))
        .select(
            "session_id",
            "video_id",
            F.when(sid % 5 == 0, F.concat(F.lit("session "), sid.cast("string"))).otherwise("").alias("title"),
            (sid % 7 == 0).alias("archived"),
            "created_s",
            "updated_s",
        )
    )


def courses(t) -> DataFrame:
    return (
        t.documents.groupBy(F.col("source").alias("video_id"))
        .agg(F.min("lang").alias("_lang"), (F.sum("n_chars") * 50).alias("duration_ms"), F.count("*").alias("n_docs"))
        .select(
            "video_id",
            F.concat(F.lit("library/"), "_lang", F.lit("/"), "video_id", F.lit(".mp4")).alias("path"),
            F.concat(F.lit("Course "), "video_id").alias("title"),
            "duration_ms",
            "n_docs",
        )
    )


def user_courses(t) -> DataFrame:
    """courses of the usage log: two of three users still have theirs, some without a title"""
    user = F.col("user_id")
    name = user.cast("string")
    return (
        t.events.filter(user % 3 != 0)
        .groupBy("user_id")
        .agg(
            F.sum(F.floor(F.col("value") * 1000).cast("long")).alias("duration_ms"),
            F.min(F.concat(F.lit("lib/"), "event_type", F.lit("/"), name, F.lit(".mp4"))).alias("path"),
        )
        .select(
            F.concat(F.lit("u"), name).alias("video_id"),
            F.when(user % 5 == 0, "").otherwise(F.concat(F.lit("Course "), name)).alias("title"),
            "duration_ms",
            "path",
        )
    )


def user_labels(t) -> DataFrame:
    name = F.col("user_id").cast("string")
    return (
        t.events.filter(F.col("user_id") % 2 == 0)
        .select(F.concat(F.lit("u"), name).alias("video_id"), F.concat(F.lit("Old "), name).alias("title"))
        .distinct()
    )
