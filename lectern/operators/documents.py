"""Document parsing: text -> chapters and timed chunks. Narrow work only: a document never leaves
its row until the finished chunks are exploded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import documents as D
from lectern.functions.lists import unfold
from lectern.functions.text import strip
from lectern.operators.segments import padded
from lectern import constants as C


def parse(docs: DataFrame) -> DataFrame:
    """``docs``: video_id, text, title (may be blank). Adds the document's display title and its
    timed chunks as an array; blank documents are dropped."""
    cleaned = docs.withColumn("text", D.clean(F.col("text"))).filter(F.col("text") != "")
    title = F.coalesce(
        F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")),
        F.nullif(D.guess_title(F.col("text")), F.lit("")),
        F.lit(C.UNNAMED_DOCUMENT),
    )
    sectioned = cleaned.withColumn("title", title).withColumn(
        "sections", D.sections(F.col("text"), F.col("title"))
    )
    pieces = F.flatten(
        F.transform(
            "sections",
            lambda s, i: F.transform(
                D.pack(D.paragraphs(F.when(s["body"] == "", s["title"]).otherwise(s["body"]))),
                lambda text: F.struct(i.alias("sec"), s["title"].alias("title"), text.alias("text")),
            ),
        )
    )
    return sectioned.withColumn("chunks", D.timeline(pieces)).drop("text", "sections")


def chunks(parsed: DataFrame) -> DataFrame:
    c = _rows(parsed)
    return c.select(
        "video_id", "idx", "start_ms", "end_ms", "text",
        F.concat_ws("-c", "video_id", padded(F.col("idx"), 4)).alias("chunk_id"),
        F.concat_ws("-ch", "video_id", padded(F.col("sec"), 3)).alias("parent_id"),
    )


def _rows(parsed: DataFrame) -> DataFrame:
    return unfold(parsed, ["video_id"], F.col("chunks"), "c").select("video_id", "c.*")


def chapters(parsed: DataFrame) -> DataFrame:
    """Sections with the span of their chunks."""
    spans = _rows(parsed).groupBy("video_id", F.col("sec").alias("idx"), F.substring("title", 1, 80).alias("title")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_chunks")
    )
    return spans.withColumn("chapter_id", F.concat_ws("-ch", "video_id", padded(F.col("idx"), 3)))
