"""Speech-recognition results: nested JSON -> sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

RESULT = (
    "struct<result:struct<utterances:array<struct<text:string,start_time:bigint,end_time:bigint,"
    "additions:struct<speaker:string>,words:array<struct<text:string,start_time:bigint,end_time:bigint,confidence:double>>>>>,"
    "audio_info:struct<duration:bigint>>"
)


def parse(json: Column) -> Column:
    return F.from_json(json, RESULT)


def utterances(replies: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """One row per sentence with text. Words with negative times are noise tokens of the service
    and are dropped, as they would look like pauses."""
    parsed = replies.select(*keys, parse(F.col(json)).alias("r"))
    rows = parsed.select(*keys, F.posexplode("r.result.utterances").alias("pos", "u"))
    words = F.filter(
        F.coalesce("u.words", F.expr("array()").cast("array<struct<text:string,start_time:bigint,end_time:bigint,confidence:double>>")),
        lambda w: (F.coalesce(w["start_time"], F.lit(-1)) >= 0) & (F.coalesce(w["end_time"], F.lit(-1)) >= 0),
    )
    return rows.select(
        *keys,
        "pos",
        F.coalesce("u.start_time", F.lit(0)).alias("start_ms"),
        F.coalesce("u.end_time", F.lit(0)).alias("end_ms"),
        strip(F.coalesce("u.text", F.lit(""))).alias("text"),
        F.col("u.additions.speaker").alias("speaker"),
        words.alias("words"),
    ).filter("text <> ''")


def outcome(json: Column) -> Column:
    """STRUCT<no_speech, duration_ms> of one reply."""
    r = parse(json)
    said = F.filter(r["result"]["utterances"], lambda u: strip(F.coalesce(u["text"], F.lit(""))) != "")
    return F.struct(
        (F.coalesce(F.size(said), F.lit(0)) <= 0).alias("no_speech"),
        F.coalesce(r["audio_info"]["duration"], F.lit(0)).alias("duration_ms"),
    )
