"""Scoring answers against a question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import answers as fa, clock, text as X


def questions(raw: DataFrame, only: str | None = None) -> DataFrame:
    """Questions with text; key points given as a single spelling become one-element lists.

    ``raw``: id, type, question, keypoints ARRAY<STRING> (JSON scalars or lists), expect_time,
    tolerance_ms.
    """
    kept = raw.filter(X.strip(F.coalesce("question", F.lit(""))) != "")
    if only is not None:
        kept = kept.filter(F.col("type") == only)

    def as_list(k: Column) -> Column:
        many = F.from_json(k, "array<string>")
        return F.when(F.ltrim(k).startswith("["), many).otherwise(F.array(k))

    return kept.select(
        "id",
        F.coalesce("type", F.lit("factual")).alias("type"),
        "question",
        F.transform(F.coalesce("keypoints", F.array().cast("array<string>")), as_list).alias("keypoints"),
        F.when(F.coalesce("expect_time", F.lit("")) != "", clock.parse_clock(F.col("expect_time"))).alias("expect_ms"),
        F.coalesce("tolerance_ms", F.lit(C.CITATION_TOLERANCE_MS)).alias("tolerance_ms"),
    )


def score(answered: DataFrame) -> DataFrame:
    """``answered``: one row per (question, answer) with keypoints (see ``ready_keypoints``),
    answer, starts ARRAY<BIGINT>, expect_ms, tolerance_ms, failed. Adds hit / total / rate /
    missing / status / score."""
    norm = fa.normalise(fa.without_extension(F.col("answer")))
    d = answered.withColumn("_norm", norm)
    d = d.withColumn("missing", fa.missing_keypoints(F.col("_norm"), F.col("keypoints")))
    total, missed = F.size("keypoints"), F.size("missing")
    ok = ~F.coalesce("failed", F.lit(False))
    d = d.withColumn("total", F.when(ok, total).otherwise(0)).withColumn("hit", F.when(ok, total - missed).otherwise(0))
    d = d.withColumn("rate", F.coalesce(F.try_divide("hit", "total"), F.lit(0.0)))
    status = F.when(ok, fa.citation_status(F.col("expect_ms"), F.col("starts"), F.col("tolerance_ms"))).otherwise("n/a")
    d = d.withColumn("status", status)
    points = F.when(ok, fa.question_score(F.col("rate"), F.col("status"))).otherwise(0.0)
    return d.withColumn("score", points).drop("_norm")


def summary(outcomes: DataFrame, *by: str, overall: bool = False) -> DataFrame:
    """Means and citation rates, overall or per group; sums only, so any group size combines early.
    ``overall`` adds the row of all groups together (named 'overall') in the same pass."""
    timed = F.count_if(F.col("status") != "n/a")

    def rate(status: str) -> Column:
        return F.coalesce(F.try_divide(F.count_if(F.col("status") == status), timed), F.lit(0.0))

    grouped = outcomes.rollup(*by) if overall else outcomes.groupBy(*by)
    out = grouped.agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("mean"),
        F.round(rate("missing"), 4).alias("no_citation_rate"),
        F.round(rate("wrong"), 4).alias("wrong_citation_rate"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("failures"),
    )
    return out.fillna("overall", subset=list(by)) if overall else out


def gate_table(spark: SparkSession) -> DataFrame:
    gates = (*C.GATES, ("wrong_citation_rate", C.WRONG_CITATION_GATE))
    rows = ", ".join(f"('{k}', {v}D)" for k, v in gates)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS g(gate, threshold)")


def gates(outcomes: DataFrame) -> DataFrame:
    """Thresholds against the means of the types that occur, the overall mean and the share of
    wrong citations."""
    means = summary(outcomes, "type", overall=True)
    wrong = F.struct(F.lit("wrong_citation_rate").alias("gate"), F.col("wrong_citation_rate").alias("value"))
    own = F.struct(F.col("type").alias("gate"), F.col("mean").alias("value"))
    values = means.select(
        F.explode(F.when(F.col("type") == "overall", F.array(own, wrong)).otherwise(F.array(own))).alias("g")
    ).select("g.*")
    limits = gate_table(outcomes.sparkSession)
    passed = F.when(F.col("gate") == "wrong_citation_rate", F.col("value") <= F.col("threshold")).otherwise(
        F.col("value") >= F.col("threshold")
    )
    return values.join(limits, "gate").withColumn("passed", passed)


def validity(outcomes: DataFrame) -> DataFrame:
    """A run with too many failed questions is no measurement."""
    return outcomes.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failures")
    ).withColumn(
        "valid", F.col("failures") < F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    )


def skeleton(spark: SparkSession, chapters: DataFrame, per_type: int = 10) -> DataFrame:
    """Empty question slots of every course; factual and visual ones carry a chapter start.

    Slot i takes chapter min(i * max(1, n div 10), n - 1). ``chapters``: video_id, idx, start_ms.
    """
    counts = chapters.groupBy("video_id").agg(F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("prefix"), F.lit(tol).alias("tolerance_ms")) for t, p, tol in C.QUESTION_TYPES])
    slots = (
        counts.select("video_id", "n", F.explode(F.sequence(F.lit(0), F.lit(per_type - 1))).alias("slot"))
        .select("video_id", "slot", "n", F.explode(kinds).alias("k"))
        .select("video_id", "slot", "k.*", F.least(F.col("slot") * F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("n") - 1).alias("idx"))
    )
    starts = chapters.select("video_id", "idx", "start_ms")
    return slots.join(starts, ["video_id", "idx"], "left").select(
        "video_id",
        F.format_string("%s%02d", "prefix", F.col("slot") + 1).alias("id"),
        "type",
        F.when(F.col("type").isin("factual", "visual"), clock.clock_label(F.col("start_ms"))).otherwise("").alias("expect_time"),
        "tolerance_ms",
    )


def write_outcomes(outcomes: DataFrame, folder: str) -> None:
    """Per-question rows and one summary row, as JSON lines."""
    outcomes.write.mode("overwrite").json(f"{folder}/answers")
    summary(outcomes).write.mode("overwrite").json(f"{folder}/summary")
