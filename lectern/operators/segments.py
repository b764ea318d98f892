"""Transcript structuring: sentences -> chunks -> chapters, slides attached by overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.operators import intervals, ordered


def padded(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def with_speaker(text: Column, speaker: Column) -> Column:
    """Name the speaker unless the recogniser gave only a default number."""
    plain = F.coalesce(speaker, F.lit("")).isin("", "0", "1")
    return F.when(plain, text).otherwise(F.concat(F.lit("["), speaker, F.lit("] "), text))


def build_chunks(
    segments: DataFrame,
    order: Sequence[str] = ("start_ms", "idx"),
    *,
    min_ms: int = C.CHUNK_MIN_MS,
    max_ms: int = C.CHUNK_MAX_MS,
    gap_ms: int = C.CHUNK_GAP_MS,
) -> DataFrame:
    """One row per chunk. A chunk spans at most ``max_ms`` plus one sentence, which bounds what is
    gathered for its text, however long the course is."""
    runs = ordered.cut_runs(
        segments, "video_id", list(order), gap_ms=gap_ms, min_span=min_ms, max_span=max_ms
    )
    at = F.struct(*[F.col(c) for c in order])
    line = with_speaker(F.col("text"), F.col("speaker"))
    return (
        runs.groupBy("video_id", F.col("run").alias("idx"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max_by("end_ms", at).alias("end_ms"),
            F.count("*").alias("n_segments"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))),
                    lambda x: x["line"],
                ),
                "\n",
            ).alias("text"),
        )
        .withColumn("chunk_id", F.concat_ws("-c", "video_id", padded(F.col("idx"), 4)))
    )


def build_chapters(
    chunks: DataFrame, *, gap_ms: int = C.CHAPTER_GAP_MS, max_span: int = C.CHAPTER_MAX_MS
) -> DataFrame:
    return chapters_of_runs(chapter_runs(chunks, gap_ms=gap_ms, max_span=max_span))


def chapters_of_runs(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("video_id", F.col("run").alias("idx"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max_by("end_ms", "idx").alias("end_ms"),
            F.count("*").alias("n_chunks"),
        )
        .withColumn("chapter_id", chapter_id(F.col("idx")))
    )


def chapter_id(number: Column) -> Column:
    return F.concat_ws("-ch", F.col("video_id"), padded(number, 3))


def chapter_runs(
    chunks: DataFrame, *, gap_ms: int = C.CHAPTER_GAP_MS, max_span: int = C.CHAPTER_MAX_MS
) -> DataFrame:
    """Chunks with the number of their chapter (column ``run``)."""
    return ordered.cut_runs(
        chunks.select("video_id", "idx", "start_ms", "end_ms"),
        "video_id", ["start_ms", "idx"], gap_ms=gap_ms, max_span=max_span,
    )


def with_parents(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Give every chunk the id of its chapter; NULL when no chapter holds it."""
    parent = runs.select("video_id", "idx", chapter_id(F.col("run")).alias("parent_id"))
    return chunks.join(parent, ["video_id", "idx"], "left")


def attach_slides(chunks: DataFrame, slides: DataFrame, slide_order: str = "slide_id") -> DataFrame:
    """Slides that overlap a chunk, and their text joined in slide order.

    Only the numbers and texts of slides that really overlap one chunk are gathered.
    """
    s = slides.select(
        "video_id", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"),
        F.struct(F.col(slide_order).alias("n"), F.col("ocr_text").alias("ocr")).alias("slide"),
    )
    pairs = intervals.overlap_join(
        chunks.select("video_id", "chunk_id", "start_ms", "end_ms"), s, ["video_id"],
        left_span=("start_ms", "end_ms"), right_span=("s_start", "s_end"),
    )
    per = pairs.groupBy("video_id", "chunk_id").agg(F.array_sort(F.collect_list("slide")).alias("_slides"))
    found = F.coalesce(F.col("_slides"), F.array().cast("array<struct<n:bigint,ocr:string>>"))
    texts = F.filter(F.transform(found, lambda x: x["ocr"]), lambda o: F.coalesce(o, F.lit("")) != "")
    return (
        chunks.join(per, ["video_id", "chunk_id"], "left")
        .withColumn("slide_idxs", F.transform(found, lambda x: x["n"]))
        .withColumn("ocr_text", F.trim(F.array_join(texts, "\n")))
        .drop("_slides")
    )


def stitch(utterances: DataFrame, key: str = "video_id") -> DataFrame:
    """Join transcripts of overlapping spans: times become absolute, and a sentence that ends no
    later than anything kept before it is dropped.

    Columns: key, span_no, span_start, pos, start_ms, end_ms (relative to the span).
    A dropped sentence never raises the latest kept end, so 'latest end so far' over all sentences
    equals that over the kept ones.
    """
    order = ["span_no", "pos"]
    absolute = utterances.withColumn("start_ms", F.col("span_start") + F.col("start_ms")).withColumn(
        "end_ms", F.col("span_start") + F.col("end_ms")
    )
    seen = ordered.prefix(
        ordered.blocks(absolute, [key], order), [key], order, {"_latest": ("max", F.col("end_ms"))}
    )
    return seen.filter(F.col("_latest").isNull() | (F.col("end_ms") > F.col("_latest"))).drop(
        "_latest", ordered.BLOCK
    )


def refresh_slide_text(chunks: DataFrame, slides: DataFrame, slide_order: str = "slide_id") -> DataFrame:
    """Rebuild slide text of chunks from their slide numbers, in list order; only changed chunks."""
    linked = chunks.select("video_id", "chunk_id", F.posexplode("slide_idxs").alias("pos", slide_order))
    texts = slides.select("video_id", slide_order, "ocr_text").filter(F.coalesce("ocr_text", F.lit("")) != "")
    rebuilt = (
        linked.join(texts, ["video_id", slide_order])
        .groupBy("video_id", "chunk_id")
        .agg(
            F.trim(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("pos", "ocr_text"))), lambda x: x["ocr_text"]), "\n"
                )
            ).alias("_new")
        )
    )
    return (
        chunks.select("video_id", "chunk_id", F.col("ocr_text").alias("_old"))
        .join(rebuilt, ["video_id", "chunk_id"], "left")
        .withColumn("ocr_text", F.coalesce("_new", F.lit("")))
        .filter(~F.col("ocr_text").eqNullSafe(F.coalesce("_old", F.lit(""))))
        .drop("_new", "_old")
    )


def time_anchors(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct start times of chapters and chunks."""
    return chapters.select("video_id", "start_ms").unionByName(chunks.select("video_id", "start_ms")).distinct()
