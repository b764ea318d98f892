"""From answers to the places they speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import answers as fa, clock
from lectern.operators import intervals, retrieval


def answer_times(answers: DataFrame) -> DataFrame:
    """Times written in an answer, in order: qid, video_id, pos, at_ms."""
    return answers.select("qid", "video_id", F.posexplode(fa.cited_labels(F.col("answer"))).alias("pos", "label")).select(
        "qid", "video_id", "pos", clock.parse_clock(F.col("label")).alias("at_ms")
    )


def picked_chunks(answers: DataFrame, chunks: DataFrame, hits: DataFrame, most: int = C.MAX_CITATIONS) -> DataFrame:
    """Chunks an answer refers to: those nearest to its written times first, then search hits.

    Cut by that priority, not by time, so that a late conclusion is not lost.
    ``hits``: qid, video_id, rank, idx.
    """
    times = answer_times(answers)
    near = intervals.nearest_span(
        times, chunks.select("video_id", "start_ms", "end_ms", "idx"), "video_id",
        point_id=["qid", "pos"], at="at_ms", span=("start_ms", "end_ms"), idx="idx",
    ).filter("idx IS NOT NULL")
    wanted = near.select("qid", "video_id", "idx", F.lit(0).alias("prio"), F.col("pos").cast("long").alias("pos")).unionByName(
        hits.select("qid", "video_id", "idx", F.lit(1).alias("prio"), F.col("rank").cast("long").alias("pos"))
    )
    first = wanted.groupBy("qid", "video_id", "idx").agg(F.min(F.struct("prio", "pos")).alias("_at"))
    return retrieval.top(first, ["qid"], [F.col("_at")], most, "priority").drop("_at")


def citations(picked: DataFrame, chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Readable citations with the title of the chapter that holds the chunk."""
    c = chunks.select("video_id", "idx", "chunk_id", "parent_id", "start_ms", "end_ms", F.substring("text", 1, C.CITATION_TEXT_CHARS).alias("text"))
    titles = chapters.select("video_id", F.col("chapter_id").alias("parent_id"), F.col("title").alias("chapter_title"))
    return (
        picked.join(c, ["video_id", "idx"]).join(titles, ["video_id", "parent_id"], "left")
        .withColumn("chapter_title", F.coalesce("chapter_title", F.lit("")))
        .withColumn("label", clock.clock_label(F.col("start_ms")))
        .drop("parent_id")
    )


def evidence_slides(hits: DataFrame, most: int = C.MAX_EVIDENCE_SLIDES) -> DataFrame:
    """First ``most`` different slides over the hits in rank order. ``hits``: qid, rank,
    slide_idxs. Stopping early after a hit that fills the list changes nothing in that prefix."""
    seen = hits.select("qid", "rank", F.posexplode("slide_idxs").alias("pos", "slide_idx"))
    first = seen.groupBy("qid", "slide_idx").agg(F.min(F.struct("rank", "pos")).alias("_at"))
    return retrieval.top(first, ["qid"], [F.col("_at")], most, "n").drop("_at")
