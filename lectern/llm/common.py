"""What the operators of this subpackage share: table access, label splits, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import prepare

#: Rows per Arrow batch. Documents reach a few hundred kilobytes, so a batch stays within tens of MB.
BATCH_ROWS = 1000
#: ASCII white space: the word pattern of every operator is a run of anything else.
WHITE = " \t\n\x0b\x0c\r"


def session(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, column: str, per_class: int | tuple[int, int], seed: int = 7) -> DataFrame:
    """A bounded sample of labelled ids outside the held-out fold: at most ``per_class`` of either class
    (a pair: of class 1, of class 0).

    Ids are taken in the order of a seeded hash. Null ids and null labels are left out, a repeated
    id counts once with its largest label. Gives rows of (doc_id, label).
    """
    ones, zeros = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    known = (
        labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(fold_of(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    order = F.xxhash64(F.lit(seed), "doc_id")
    return known.filter("label = 1").orderBy(order, "doc_id").limit(ones).unionAll(
        known.filter("label = 0").orderBy(order, "doc_id").limit(zeros)
    )


def training_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int | tuple[int, int]) -> DataFrame:
    """Whole texts of the sampled labelled ids: (doc_id, text, label), null texts as empty.

    The sample has at most ``per_class`` rows a class, of twelve bytes each, which is what bounds the broadcast.
    """
    sample = F.broadcast(training_labels(labels, column, per_class))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
