"""Call prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as C


def is_peak(at: Column) -> Column:
    """Beijing working days 9-12 and 14-18, half open. ``at`` is UTC."""
    local = at.cast("timestamp_ntz") + F.expr("INTERVAL '8' HOUR")
    hour = F.hour(local)
    busy = hour.between(9, 11) | hour.between(14, 17)
    return (F.weekday(local) < 5) & busy


def call_cost(
    prompt: Column, cached: Column, output: Column, hit: Column, miss: Column, out: Column
) -> Column:
    """Yuan; NULL when the price is NULL, so an unknown price never reads as free."""
    used = F.greatest(F.lit(0), F.least(cached, prompt))
    fresh = F.greatest(F.lit(0), prompt - used)
    return (used * hit + fresh * miss + output * out) / F.lit(1_000_000.0)


def speech_cost(audio_ms: Column) -> Column:
    return audio_ms / F.lit(3_600_000.0) * F.lit(C.ASR_YUAN_PER_HOUR)


def cache_rate(cached: Column, prompt: Column) -> Column:
    return F.coalesce(F.try_divide(cached, prompt), F.lit(0.0))
