"""WebVTT subtitles from transcript sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import clock, text


def cues(segments: DataFrame, order: str = "seg_id") -> DataFrame:
    """One cue per filled sentence. Cues stay rows: a course of any length needs no gathering."""
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1500).otherwise(F.col("end_ms"))
    body = F.replace(text.strip(F.col("text")), F.lit("-->"), F.lit("→"))
    return segments.filter(text.strip(F.coalesce("text", F.lit(""))) != "").select(
        "video_id",
        order,
        "start_ms",
        F.concat(
            clock.vtt_stamp(F.col("start_ms")), F.lit(" --> "), clock.vtt_stamp(end), F.lit("\n"), body, F.lit("\n")
        ).alias("cue"),
    )


def write(segments: DataFrame, folder: str, order: str = "seg_id") -> None:
    """Text files under ``video_id=...``; parts of one course read in name order are its cues."""
    rows = cues(segments, order)
    head = rows.select("video_id").distinct().select(
        "video_id", F.lit(None).cast(rows.schema[order].dataType).alias(order),
        F.lit(None).cast("long").alias("start_ms"), F.lit("WEBVTT\n").alias("cue"),
    )
    (
        head.unionByName(rows)
        .repartitionByRange("video_id", F.col("start_ms").asc_nulls_first(), F.col(order).asc_nulls_first())
        .sortWithinPartitions("video_id", F.col("start_ms").asc_nulls_first(), F.col(order).asc_nulls_first())
        .select("video_id", F.col("cue").alias("value"))
        .write.partitionBy("video_id").mode("overwrite").text(folder)
    )
