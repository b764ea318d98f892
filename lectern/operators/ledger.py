"""Usage ledger: pricing and roll-ups. A NULL cost means 'price unknown' and is never merged with 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import tariff

TOKENS = ("prompt_tokens", "cached_tokens", "completion_tokens", "audio_ms")


def price_table(spark: SparkSession, prices=C.PRICES) -> DataFrame:
    rows = ", ".join(f"('{m}', '{t}', {h}D, {i}D, {o}D)" for m, t, h, i, o in prices)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS p(model, tier, hit, miss, out)")


def price_calls(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds ``peak`` and ``cost`` at the price in force when the call was made."""
    if prices is None:
        prices = price_table(calls.sparkSession)
    tiered = calls.withColumn("peak", tariff.is_peak(F.col("at"))).withColumn(
        "tier", F.when(F.col("peak"), "peak").otherwise("off_peak")
    )
    return (
        tiered.join(prices, ["model", "tier"], "left")
        .withColumn(
            "cost",
            tariff.call_cost(
                F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"),
                F.col("hit"), F.col("miss"), F.col("out"),
            ),
        )
        .drop("tier", "hit", "miss", "out")
    )


def _sums() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"),
    ]


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(*_sums()).withColumn("cost", F.round("cost", 4))


def by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*_sums())


def by_course(usage: DataFrame, courses: DataFrame, labels: DataFrame) -> DataFrame:
    """Roll up first, then look the titles up: the joins see one row per course, not per call."""
    return with_titles(by(usage, "video_id"), courses, labels)


def with_titles(per: DataFrame, courses: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds title and deleted to one row per course."""
    known = courses.select("video_id", F.col("title").alias("_now"), F.lit(True).alias("_known"))
    kept = labels.select("video_id", F.col("title").alias("_kept"))
    raw = F.trim(
        F.coalesce(F.nullif("_now", F.lit("")), F.nullif("_kept", F.lit("")), F.lit(""))
    )
    titled = (
        per.join(known, "video_id", "left").join(kept, "video_id", "left")
        .withColumn("deleted", F.col("_known").isNull())
        .withColumn("_raw", F.when(raw == F.col("video_id"), "").otherwise(raw))
    )
    return titled.withColumn("title", course_title(F.col("video_id"), F.col("_raw"), F.col("deleted"))).drop(
        "_now", "_known", "_kept", "_raw"
    )


def course_title(video_id: Column, title: Column, deleted: Column) -> Column:
    """A deleted course keeps its title in the report instead of turning into a bare id."""
    gone = F.when(title != "", F.concat(F.lit("已删除 · "), title)).when(
        video_id != "", F.concat(F.lit("已删除课程（"), F.substring(video_id, 1, 8), F.lit("…）"))
    ).otherwise(F.lit("已删除课程"))
    here = F.coalesce(F.nullif(title, F.lit("")), F.nullif(video_id, F.lit("")), F.lit("未命名"))
    return F.when(deleted, gone).otherwise(here)


def by_day(usage: DataFrame, newest: int = 30) -> DataFrame:
    return (
        by(usage.withColumn("day", F.date_format("at", "yyyy-MM-dd")), "day")
        .orderBy(F.col("day").desc())
        .limit(newest)
    )


def report(usage: DataFrame) -> DataFrame:
    """All roll-ups in one pass over the log. ``level`` says which one a row belongs to."""
    day = usage.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    sets = [[], ["kind"], ["model", "kind"], ["video_id"], ["day"]]
    names = ["total", "kind", "model", "course", "day"]
    keys = ["kind", "model", "video_id", "day"]
    grouped = day.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        *_sums(), F.grouping_id().alias("_gid")
    )
    level = F.lit(None)
    for s, name in zip(sets, names):
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        level = F.when(F.col("_gid") == gid, name).otherwise(level)
    return grouped.withColumn("level", level).drop("_gid")


def summary(usage: DataFrame, courses: DataFrame, labels: DataFrame, newest: int = 30) -> DataFrame:
    """The whole usage report: level, name, title and deleted (of courses), calls, cost, unpriced.

    Every course that was ever called is listed, also without a priced call; deleted ones keep their last title.
    Only the ``newest`` days are shown.
    """
    rows = report(usage)
    level = F.col("level")
    name = (
        F.when(level == "model", F.concat_ws("/", "model", "kind")).when(level == "kind", F.col("kind"))
        .when(level == "course", F.col("video_id")).when(level == "day", F.col("day")).otherwise("")
    )
    figures = ["calls", F.coalesce("cost", F.lit(0.0)).alias("cost"), "unpriced"]
    none = [F.lit(None).cast("string").alias("title"), F.lit(None).cast("boolean").alias("deleted")]
    titled = with_titles(rows.filter(level == "course"), courses, labels)
    days = rows.filter(level == "day").orderBy(F.col("day").desc()).limit(newest)
    rest = rows.filter(~level.isin("course", "day")).unionByName(days)
    return titled.select("level", F.coalesce("video_id", F.lit("")).alias("name"), "title", "deleted", *figures).unionByName(
        rest.select("level", F.coalesce(name, F.lit("")).alias("name"), *none, *figures)
    )


def missing_speech_rows(courses: DataFrame, segments: DataFrame, usage: DataFrame) -> DataFrame:
    """Speech-to-text rows for courses that were transcribed but never booked."""
    return (
        courses.filter(F.coalesce("duration_ms", F.lit(0)) > 0)
        .join(segments.select("video_id").distinct(), "video_id", "left_semi")
        .join(usage.filter("kind = 'asr'").select("video_id").distinct(), "video_id", "left_anti")
        .select(
            "video_id",
            F.lit("asr").alias("kind"),
            F.lit(C.ASR_MODEL).alias("model"),
            F.col("duration_ms").alias("audio_ms"),
            tariff.speech_cost(F.col("duration_ms")).alias("cost"),
        )
    )


def merged_usage(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in TOKENS[:3]]
    ).withColumn("cache_rate", tariff.cache_rate(F.col("cached_tokens"), F.col("prompt_tokens")))
