"""Ordered work within a key of any size.

A window partitioned by course would send a whole course to one task, and one course may hold a
third of all rows. Here the rows are range-partitioned by (key, order), so a large key is spread
over many *blocks*; each block is worked on alone and the little that crosses block borders is
carried over in a table with at most one row per block.

``blocks``     range partition, sort, settle: every row knows its block
``prefix``     running sum / count / max / last value over a whole key, forwards or backwards
``cut_runs``   the resetting fold (a new run starts when a pause or a span limit says so)
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import settle

BLOCK = "_blk"


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """Spread ``df`` over blocks by (keys, order), sorted inside. ``order`` must end in
    something unique within the key, so that no tie is too large to be cut. Without ``n`` Spark sizes the
    blocks by the data (neighbouring ranges are merged up to the advisory partition size)."""
    by = [*keys, *order]
    placed = (
        (df.repartitionByRange(n, *by) if n else df.repartitionByRange(*by))
        .sortWithinPartitions(*keys, *order)
        .withColumn(BLOCK, F.spark_partition_id())
    )
    return settle(placed)


def _windowed(kind: str, value: Column, order: Sequence[Column], w) -> Column:
    if kind == "sum":
        return F.sum(value).over(w)
    if kind == "count":
        return F.count(value).over(w)
    if kind == "max":
        return F.max(value).over(w)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    raise ValueError(kind)


def _whole_block(kind: str, value: Column, at: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), at))
    return {"sum": F.sum, "count": F.count, "max": F.max}[kind](value)


def prefix(
    blocked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = False,
    backwards: bool = False,
) -> DataFrame:
    """Running values over each key of a ``blocks`` result.

    ``specs`` maps a new column to (kind, value), kind one of sum, count, max, last. Exclusive
    unless ``inclusive``; ``backwards`` runs from the end of the key, so ``last`` then gives the
    nearest following value.
    """
    by = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = Window.partitionBy(BLOCK, *keys).orderBy(*by)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    # One row per (block, key); only the rows of keys that began in an earlier block are kept, and
    # a block has at most one such key, so the carry table never exceeds the number of blocks.
    at = F.struct(*[F.col(c) for c in order])
    if backwards:
        whole = [
            (F.min_by(v, F.when(v.isNotNull(), at)) if kind == "last" else _whole_block(kind, v, at)).alias(name)
            for name, (kind, v) in specs.items()
        ]
    else:
        whole = [_whole_block(kind, v, at).alias(name) for name, (kind, v) in specs.items()]
    totals = blocked.groupBy(BLOCK, *keys).agg(*whole)
    over_blocks = Window.partitionBy(*keys).orderBy(
        F.col(BLOCK).desc() if backwards else F.col(BLOCK).asc()
    )
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.select(
            BLOCK,
            *keys,
            F.row_number().over(over_blocks).alias("_nth"),
            *[
                (
                    F.sum(name) if kind in ("sum", "count") else F.max(name)
                    if kind == "max" else F.last(name, ignorenulls=True)
                ).over(before).alias(f"_carry_{name}")
                for name, (kind, _v) in specs.items()
            ],
        )
        .filter(F.col("_nth") > 1)
        .drop("_nth")
    )

    local = blocked.select(
        "*",
        *[
            _windowed(kind, v, by, inside).alias(f"_local_{name}")
            for name, (kind, v) in specs.items()
        ],
    )
    joined = local.join(F.broadcast(carry), [BLOCK, *keys], "left")

    def merged(name: str, kind: str) -> Column:
        here, earlier = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind in ("sum", "count"):
            return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        if kind == "max":
            return F.greatest(here, earlier)
        return F.coalesce(here, earlier)

    return joined.select(
        *[c for c in blocked.columns],
        *[merged(name, kind).alias(name) for name, (kind, _v) in specs.items()],
    )


# --------------------------------------------------------------------------- resetting fold


def _threshold(end: float, gap: float, gap_ms: float, min_span: float, max_span: float) -> float:
    """A run that began at ``s`` must be cut before this row iff ``s`` <= the returned value."""
    limit = end - max_span
    if gap >= gap_ms:
        limit = max(limit, end - min_span)
    return limit


def _frames(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        if len(pdf):
            yield pdf


_META = (
    "blk int, key string, role int, first_start long, first_end long, last_end long,"
    " upto double, exit_start long, exit_cuts long"
)
_FRESH, _STEP, _ORIGIN = 0, 1, 2


def _leaves(starts: list, limits: list) -> list[tuple[int, int]]:
    """Run start and number of cuts at the end of the block, for a run begun at each row.

    From the last row backwards. ``stairs`` holds the rows that may be the next cut of an earlier run: their limits
    fall towards the top, so the nearest one that reaches a run's start is found by bisection.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(starts)
    stairs: list[int] = []
    for i in range(len(starts) - 1, -1, -1):
        at = bisect_right(stairs, -starts[i], key=lambda k: -limits[k])
        if at:
            final, cuts = out[stairs[at - 1]]
            out[i] = (final, cuts + 1)
        else:
            out[i] = (starts[i], 0)
        while stairs and limits[stairs[-1]] <= limits[i]:
            stairs.pop()
        stairs.append(i)
    return out


def _block_summary(key: str, start: str, end: str, gap_ms: int, min_span: int, max_span: int):
    """Per block: what becomes of a run that enters it, as a step function of the run's start.

    Emits for the block's first key one row per step (``upto`` = largest entry start for which the
    step holds; the first row itself is judged later, when the entry is known), one row for a key
    that begins in this block and reaches its end.
    """

    def summarise(batches):
        first_key, starts, ends = None, [], []
        live_key, live_start, live_end = None, 0, 0
        cuts_live = 0
        blk = None
        for pdf in _frames(batches):
            if blk is None:
                blk = int(pdf[BLOCK].iat[0])
                first_key = pdf[key].iat[0]
            for k, s, e in zip(pdf[key].tolist(), pdf[start].tolist(), pdf[end].tolist()):
                if k == first_key:
                    starts.append(s)
                    ends.append(e)
                elif k != live_key:
                    live_key, live_start, live_end, cuts_live = k, s, e, 0
                else:
                    if live_start <= _threshold(e, s - live_end, gap_ms, min_span, max_span):
                        live_start = s
                        cuts_live += 1
                    live_end = e
        if blk is None:
            return
        limits = [float("-inf")] + [
            _threshold(ends[i], starts[i] - ends[i - 1], gap_ms, min_span, max_span)
            for i in range(1, len(starts))
        ]
        leaves = _leaves(starts, limits)
        rows = []

        def add(role, upto, exit_start, cuts, k=first_key, fs=starts[0], fe=ends[0], le=ends[-1]):
            rows.append((blk, k, role, fs, fe, le, upto, exit_start, cuts))

        add(_FRESH, None, *leaves[0])
        high, step = float("-inf"), None
        for i in range(1, len(starts)):
            if limits[i] > high:
                if step not in (None, leaves[i]):
                    add(_STEP, high, step[0], step[1] + 1)
                high, step = limits[i], leaves[i]
                if high >= starts[0]:
                    break
        if step is not None:
            add(_STEP, high, step[0], step[1] + 1)
        if live_key is not None:
            add(_ORIGIN, None, live_start, cuts_live, live_key, 0, 0, live_end)
        yield pd.DataFrame(
            rows,
            columns=["blk", "key", "role", "first_start", "first_end", "last_end", "upto", "exit_start", "exit_cuts"],
        )

    return summarise


def _chain(gap_ms: int, min_span: int, max_span: int):
    """Walk the blocks of one key and say with which run each block is entered."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        state = None  # (run start, run number, last end)
        for blk, part in pdf.sort_values(["blk", "role"]).groupby("blk", sort=True):
            origin = part[part.role == _ORIGIN]
            if len(origin):
                o = origin.iloc[0]
                state = (int(o.exit_start), int(o.exit_cuts), int(o.last_end))
                continue
            fresh = part[part.role == _FRESH].iloc[0]
            last_end = int(fresh.last_end)
            if state is None:
                state = (int(fresh.exit_start), int(fresh.exit_cuts), last_end)
                continue
            run_start, run, prev_end = state
            out.append((int(blk), fresh.key, run_start, run, prev_end))
            edge = _threshold(
                int(fresh.first_end), int(fresh.first_start) - prev_end, gap_ms, min_span, max_span
            )
            if run_start <= edge:
                state = (int(fresh.exit_start), run + 1 + int(fresh.exit_cuts), last_end)
                continue
            steps = part[(part.role == _STEP) & (part.upto >= run_start)].sort_values("upto")
            if len(steps):
                s = steps.iloc[0]
                state = (int(s.exit_start), run + int(s.exit_cuts), last_end)
            else:
                state = (run_start, run, last_end)
        return pd.DataFrame(out, columns=["blk", "key", "in_start", "in_run", "in_end"])

    return chain


def cut_runs(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    start: str = "start_ms",
    end: str = "end_ms",
    gap_ms: int,
    max_span: int,
    min_span: int = 0,
) -> DataFrame:
    """Number the runs of each key from 0 (column ``run``).

    A row opens a new run if (pause before it >= ``gap_ms`` and span so far including it >=
    ``min_span``) or span >= ``max_span``; the span counts from the first row of the current run.
    Start times must not decrease in ``order``.

    The state resets, so this is no plain window. Each block is summarised as a step function of
    the run that enters it, the summaries (a few rows per block) are chained per key, and a second
    pass numbers the runs while streaming through the sorted blocks. Only keys, order and times go through the
    blocks and Python; the run numbers are joined back to the rows.
    """
    blocked = blocks(df.select(*dict.fromkeys([key, *order, start, end])), [key], order)
    times = blocked.select(BLOCK, F.col(key).cast("string").alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    summary = times.mapInPandas(_block_summary("_k", "_s", "_e", gap_ms, min_span, max_span), _META)
    entries = summary.groupBy("key").applyInPandas(
        _chain(gap_ms, min_span, max_span),
        "blk int, key string, in_start long, in_run long, in_end long",
    )
    # at most one entry per block, so the size of this side is the number of blocks
    carried = (
        blocked.withColumn("_k", F.col(key).cast("string"))
        .join(
            F.broadcast(entries.select(F.col("blk").alias(BLOCK), F.col("key").alias("_k"), "in_start", "in_run", "in_end")),
            [BLOCK, "_k"],
            "left",
        )
        .select(*blocked.columns, "in_start", "in_run", "in_end")
    )

    def number(batches):
        live_key, run_start, run, prev_end = None, 0, 0, 0
        for pdf in _frames(batches):
            runs = []
            for k, s, e, i_start, i_run, i_end in zip(
                pdf[key].tolist(), pdf[start].tolist(), pdf[end].tolist(),
                pdf["in_start"].tolist(), pdf["in_run"].tolist(), pdf["in_end"].tolist(),
            ):
                if k != live_key:
                    live_key = k
                    if i_start == i_start and i_start is not None:
                        run_start, run, prev_end = i_start, int(i_run), i_end
                    else:
                        run_start, run, prev_end = s, 0, e
                        runs.append(0)
                        continue
                if run_start <= _threshold(e, s - prev_end, gap_ms, min_span, max_span):
                    run_start = s
                    run += 1
                prev_end = e
                runs.append(run)
            out = pdf.drop(columns=[BLOCK, "in_start", "in_run", "in_end"])
            out["run"] = runs
            yield out

    kept = [f for f in blocked.schema.fields if f.name != BLOCK]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", run long"
    runs = carried.mapInPandas(number, schema).select(key, *order, "run")
    return df.join(runs, [key, *order]).select(*df.columns, "run")
