"""Joins on time: overlap, stabbing, nearest, tolerance.

All are equi-joins on (key, level, time bin) with an exact residual. Level k has bins of ``width * BASE**k``. A span lives on the
finest level where it covers at most BASE + 1 bins, so a span of a year makes as few rows as one of a minute; on coarser levels it
covers two bins at most. A pair meets on the coarser of its two levels, in the first bin that both cover.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import blocks, prefix

BIN_MS = 60_000


def bin_of(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("long")


BASE, TOP = 16, 6


def _level_width(level: Column, width: int) -> Column:
    return F.element_at(F.array(*[F.lit(width * BASE**k) for k in range(TOP)]), (level + 1).cast("int"))


def _on_levels(df: DataFrame, start: str, end: str, width: int, tag: str) -> DataFrame:
    """A row per level from a span's own one upwards, and bin covered there: ``<tag>l``, ``<tag>b``, the first bin ``<tag>0``, and whether
    it is the own level. An end before the start counts as the start."""
    length = F.col(end) - F.col(start)
    own = F.lit(0)
    for k in range(TOP - 1):
        own = own + F.when(length > width * BASE ** (k + 1), 1).otherwise(0)
    rows = df.withColumn(f"{tag}own", own).select("*", F.explode(F.sequence(F.col(f"{tag}own"), F.lit(TOP - 1))).alias(f"{tag}l"))
    wide = _level_width(F.col(f"{tag}l"), width)
    first, last = F.floor(F.col(start) / wide).cast("long"), F.floor(F.col(end) / wide).cast("long")
    rows = rows.withColumns({f"{tag}own": F.col(f"{tag}own") == F.col(f"{tag}l"), f"{tag}0": first})
    return rows.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias(f"{tag}b"))


def _levels_of(rows: DataFrame, tag: str, name: str) -> DataFrame:
    """Levels in use: TOP rows at most, which bounds the broadcast."""
    return F.broadcast(rows.select(F.col(f"{tag}l").alias(name)).distinct())


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int = BIN_MS,
) -> DataFrame:
    """Pairs with ``l.start < r.end and r.start < l.end`` (touching ends do not overlap)."""
    a = _on_levels(left, *left_span, width, "_l")
    b = _on_levels(right, *right_span, width, "_r")
    b = b.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = (F.col("_ll") == F.col("_rl")) & (F.col("_lb") == F.col("_rb"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0]))
    cond = cond & (F.col("_lb") == F.greatest("_l0", "_r0"))
    # of each pair the one with the longer span is on its own level; coarser rows of the other side go only where such spans are
    a_own, b_own = a.filter("_lown"), b.filter("_rown")
    b_near = b.join(_levels_of(a_own, "_l", "_rl"), "_rl", "left_semi")
    a_above = a.filter("NOT _lown").join(_levels_of(b_own, "_r", "_ll"), "_ll", "left_semi")
    pairs = a_own.join(b_near, cond).unionByName(a_above.join(b_own, cond))
    return pairs.drop("_ll", "_lb", "_l0", "_lown", "_rl", "_rb", "_r0", "_rown", *[f"_k_{k}" for k in keys])


def stab_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    span: tuple[str, str],
    width: int = BIN_MS,
) -> DataFrame:
    """Spans that hold the point, both ends included."""
    s = _on_levels(spans, *span, width, "_s").filter("_sown")
    s = s.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in s.columns])
    p = points.select("*", F.explode(F.array(*[F.lit(k) for k in range(TOP)])).alias("_pl"))
    p = p.join(_levels_of(s, "_s", "_pl"), "_pl", "left_semi").withColumn("_pb", F.floor(F.col(at) / _level_width(F.col("_pl"), width)).cast("long"))
    cond = (F.col("_pl") == F.col("_sl")) & (F.col("_pb") == F.col("_sb"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & (F.col(span[0]) <= F.col(at)) & (F.col(span[1]) >= F.col(at))
    return p.join(s, cond).drop("_pl", "_pb", "_sl", "_sb", "_s0", "_sown", *[f"_k_{k}" for k in keys])


def nearest_span(
    points: DataFrame,
    spans: DataFrame,
    key: str,
    *,
    point_id: Sequence[str],
    at: str,
    span: tuple[str, str],
    idx: str,
    width: int = BIN_MS,
) -> DataFrame:
    """For every point the nearest span: distance 0 inside, else |start - point|; ties go to the
    lowest ``idx``. Returns point_id + key + at + ``idx`` + distance (NULL if the key has no span).

    Spans that hold the point come from a join on levels. For the rest only the last start before and
    the first start after can win; those come from one ordered pass over points and starts.
    """
    inside = (
        stab_join(points.select(*point_id, key, at), spans.select(key, *span, idx), [key], at=at, span=span, width=width)
        .groupBy(*point_id, key, at)
        .agg(F.min(idx).alias("_in"))
    )
    starts = spans.groupBy(key, F.col(span[0]).alias("_at")).agg(F.min(idx).alias("_idx"))
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in point_id]
    line = points.select(
        *point_id, key, F.col(at).alias("_at"), F.lit(None).cast("struct<s:bigint,i:bigint>").alias("_s")
    ).unionByName(
        starts.select(
            *blank, key, "_at", F.struct(F.col("_at").cast("long").alias("s"), F.col("_idx").cast("long").alias("i")).alias("_s")
        )
    )
    line = line.withColumn("_tag", F.col("_s").isNull().cast("int"))
    order = ["_at", "_tag", *point_id]
    line = blocks(line, [key], order)
    line = prefix(line, [key], order, {"_before": ("last", F.col("_s"))})
    line = prefix(line, [key], order, {"_after": ("last", F.col("_s"))}, backwards=True)
    line = line.filter("_tag = 1").withColumnRenamed("_at", at)

    def candidate(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.abs(F.col(f"{c}.s") - F.col(at)).alias("d"), F.col(f"{c}.i").alias("i")),
        )

    best = F.least(candidate("_before"), candidate("_after"))
    joined = line.join(inside, [*point_id, key, at], "left")
    return joined.select(
        *point_id,
        key,
        at,
        F.coalesce(F.col("_in").cast("long"), best["i"]).alias(idx),
        F.when(F.col("_in").isNotNull(), F.lit(0)).otherwise(best["d"]).cast("long").alias("distance"),
    )


def tolerance_semi(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    anchor: str,
    tolerance: int,
    how: str = "left_semi",
) -> DataFrame:
    """Points with an anchor of the same key at most ``tolerance`` away."""
    width = max(tolerance, 1)
    p = points.withColumn("_pb", bin_of(F.col(at), width))
    own = bin_of(F.col(anchor), width)
    a = anchors.select(
        *[F.col(k).alias(f"_a_{k}") for k in keys],
        F.col(anchor).alias("_a"),
        F.explode(F.array(own - 1, own, own + 1)).alias("_ab"),
    ).distinct()
    cond = F.col("_pb") == F.col("_ab")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_a_{k}"))
    cond = cond & (F.abs(F.col(at) - F.col("_a")) <= tolerance)
    return p.join(a, cond, how).drop("_pb")
