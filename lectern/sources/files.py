"""Document files: scan, decode."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as C
from lectern.functions import paths


def scan(spark: SparkSession, locations: Sequence[str]) -> DataFrame:
    """All document files under the given files and folders, each path once (case ignored).

    Names are filtered before contents are read; the first spelling in path order wins.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(locations))
        .filter(paths.is_document(F.col("path"), C.DOCUMENT_SUFFIXES))
    )
    # only paths are compared; what meets the contents is the short list of spellings that lose
    names = files.select("path")
    first = names.groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("_first"), F.count("*").alias("_n"))
    lost = names.withColumn("_key", F.lower("path")).join(first.filter("_n > 1"), "_key").filter("path <> _first")
    return files.join(lost.select("path"), "path", "left_anti")


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            return raw.decode("utf-8", errors="replace")

    return content.map(one)


def decode(df: DataFrame, content: str = "content", into: str = "text") -> DataFrame:
    """UTF-8 where valid; only the other files go through Python (GB18030, then replacement)."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    other = F.when(~valid, F.col(content))
    return df.withColumn("_other", _decode_other(other)).withColumn(
        into, F.when(valid, F.decode(F.col(content), "UTF-8")).otherwise(F.col("_other"))
    ).drop("_other")


def document_ids(files: DataFrame) -> DataFrame:
    """Stable id of a file from path, size and modification second."""
    return files.withColumn(
        "video_id", paths.file_id(F.col("path"), F.col("length"), F.unix_timestamp("modificationTime"))
    )
