"""Time labels. Times are whole milliseconds as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def whole_seconds(ms: Column) -> Column:
    return _div(F.greatest(F.lit(0), ms), 1000)


def clock_label(ms: Column) -> Column:
    """75 000 -> 01:15, 3 725 000 -> 01:02:05; negative times count as 0."""
    total = whole_seconds(ms)
    hours, minutes, seconds = _div(total, 3600), _div(total % 3600, 60), total % 60
    return F.when(
        hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, seconds)
    ).otherwise(F.format_string("%02d:%02d", minutes, seconds))


def parse_clock(label: Column) -> Column:
    """[HH:]MM:SS -> milliseconds."""
    parts = F.split(F.trim(label), ":")

    def field(from_end: int) -> Column:
        return F.when(
            F.size(parts) >= from_end, F.element_at(parts, -from_end).cast("long")
        ).otherwise(F.lit(0))

    return ((field(3) * 60 + field(2)) * 60 + field(1)) * 1000


def vtt_stamp(ms: Column) -> Column:
    ms = F.greatest(F.lit(0), ms)
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        _div(ms, 3_600_000),
        _div(ms % 3_600_000, 60_000),
        _div(ms % 60_000, 1000),
        ms % 1000,
    )


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)
