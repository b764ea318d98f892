"""Registration of queries with their SQL equivalents.

A query declares its output columns once. The Spark result is projected to them, and the SQL text
is wrapped in the same projection, so both sides agree on names, types and rounding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.views import VIEWS
from lectern.schemas import TABLES
from lectern.session import prepare

DIGITS = 6
TEXT_TABLES = ("documents", "pages")
_SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}

_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The shared parquet tables of one folder, opened on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self._open(name)
        setattr(self, name, table)
        return table

    def _open(self, name: str) -> DataFrame:
        table = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
        # how input is split is up to the caller and spark.sql.files.maxPartitionBytes; a session may ask
        # for the text tables to be dealt out anew, whatever their size and place
        parts = self.spark.conf.get("spark.lectern.inputPartitions", None)
        return table.repartition(int(parts)) if parts and name in TEXT_TABLES else table


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in spec.split(",")]


def _digits(kind: str) -> int:
    """'double' is rounded to DIGITS, 'double:9' to 9 digits."""
    return int(kind.partition(":")[2] or DIGITS)


def _needed_views(body: str) -> list[str]:
    """Views named in ``body``, with the views those stand on, in order of definition."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(VIEWS[name])

    add(body)
    return [name for name in VIEWS if name in needed]


def _sql(body: str, columns: list[tuple[str, str]]) -> str:
    picks = ", ".join(
        f"round(CAST({n} AS DOUBLE), {_digits(t)}) AS {n}"
        if t.startswith("double") else f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}"
        for n, t in columns
    )
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _needed_views(body)]
    body = body.strip()
    if re.match(r"(?i)with\s", body):
        # the body brings its own common tables; its last statement follows the marker line
        own, final = body.rsplit("\n---\n", 1)
        ctes.append(re.sub(r"(?i)^with\s+(recursive\s+)?", "", own.strip()))
        body = final
    head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {picks} FROM ({body}) AS result"


def _project(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(n).cast("double"), _digits(t)).alias(n)
            if t.startswith("double") else F.col(n).cast(t).alias(n)
            for n, t in columns
        ]
    )


def query(name: str, columns: str, sql: str | None = None):
    cols = _columns(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _RUNS:
            raise ValueError(f"query {name} registered twice")
        _RUNS[name] = lambda spark, folder: _project(fn(Tables(spark, folder)), cols)
        if sql is not None:
            _SQL[name] = _sql(sql, cols)
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUNS)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
