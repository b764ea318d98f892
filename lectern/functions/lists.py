"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; inside lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfold(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """Explode a computed array.

    The outer form plus a test on the element: for the inner form Spark also tests the array for
    emptiness below the projection, which would compute it a second time.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())
