"""Usage ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ledger
from lectern.plans import adapters as A
from lectern.plans.registry import query

_SUMS = (
    "count(*) AS calls, coalesce(sum(prompt_tokens), 0) AS prompt_tokens, coalesce(sum(cached_tokens), 0) AS cached_tokens,"
    " coalesce(sum(completion_tokens), 0) AS completion_tokens, coalesce(sum(audio_ms), 0) AS audio_ms,"
    " coalesce(sum(cost), 0) AS cost, count(*) FILTER (cost IS NULL) AS unpriced"
)
_COLS = (
    "calls long, prompt_tokens long, cached_tokens long, completion_tokens long, audio_ms long, cost double:9, unpriced long"
)


@query("usage_totals", _COLS, f"SELECT * REPLACE (round(cost, 4) AS cost) FROM (SELECT {_SUMS} FROM v_usage)")
def usage_totals(t):
    return ledger.totals(A.usage(t))


@query("usage_by_kind", f"kind string, {_COLS}", f"SELECT kind, {_SUMS} FROM v_usage GROUP BY kind")
def usage_by_kind(t):
    return ledger.by(A.usage(t), "kind")


@query("usage_by_model", f"model string, kind string, {_COLS}", f"SELECT model, kind, {_SUMS} FROM v_usage GROUP BY model, kind")
def usage_by_model(t):
    return ledger.by(A.usage(t), "model", "kind")


# a deleted course (v) keeps the title it was remembered by (l)
_TITLE = """CASE WHEN v.video_id IS NULL AND coalesce(nullif(l.title, ''), '') <> '' THEN '已删除 · ' || l.title
            WHEN v.video_id IS NULL THEN '已删除课程（' || substring(u.video_id, 1, 8) || '…）'
            ELSE coalesce(nullif(v.title, ''), nullif(l.title, ''), u.video_id) END"""


@query("usage_by_course", f"video_id string, title string, deleted boolean, {_COLS}", f"""
SELECT u.*, v.video_id IS NULL AS deleted,
       {_TITLE} AS title
FROM (SELECT video_id, {_SUMS} FROM v_usage GROUP BY video_id) u
LEFT JOIN v_user_courses v ON v.video_id = u.video_id
LEFT JOIN v_user_labels l ON l.video_id = u.video_id""")
def usage_by_course(t):
    return ledger.by_course(A.usage(t), A.user_courses(t), A.user_labels(t))


@query("usage_by_day", f"day string, {_COLS}", f"""
SELECT strftime(called_at, '%Y-%m-%d') AS day, {_SUMS} FROM v_usage GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def usage_by_day(t):
    return ledger.by_day(A.usage(t))


@query("day_report", "day string, calls long, cost double:9", """
SELECT strftime(called_at, '%Y-%m-%d') AS day, count(*) AS calls, coalesce(sum(cost), 0) AS cost
FROM v_usage GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def day_report(t):
    return ledger.by_day(A.usage(t), newest=7)


_SETS = f"""
SELECT CASE WHEN grouping(kind, model, video_id, day) = 15 THEN 'total' WHEN grouping(kind, model, video_id, day) = 7 THEN 'kind'
            WHEN grouping(kind, model, video_id, day) = 3 THEN 'model' WHEN grouping(kind, model, video_id, day) = 13 THEN 'course'
            ELSE 'day' END AS level, kind, model, video_id, day, {_SUMS}
FROM (SELECT *, strftime(called_at, '%Y-%m-%d') AS day FROM v_usage)
GROUP BY GROUPING SETS ((), (kind), (model, kind), (video_id), (day))"""


@query("usage_grouping_sets", f"level string, kind string, model string, video_id string, day string, {_COLS}", _SETS)
def usage_grouping_sets(t):
    return ledger.report(A.usage(t))


@query("usage_summary", "level string, name string, title string, deleted boolean, calls long, cost double:9, unpriced long", f"""
SELECT level, name, title, deleted, calls, cost, unpriced FROM (
  SELECT level, coalesce(CASE level WHEN 'model' THEN model || '/' || kind WHEN 'kind' THEN kind WHEN 'course' THEN u.video_id WHEN 'day' THEN day END, '') AS name,
         CASE WHEN level = 'course' THEN {_TITLE} END AS title, CASE WHEN level = 'course' THEN v.video_id IS NULL END AS deleted,
         calls, coalesce(cost, 0) AS cost, unpriced, row_number() OVER (PARTITION BY level ORDER BY day DESC) AS nth
  FROM ({_SETS}) u LEFT JOIN v_user_courses v ON v.video_id = u.video_id LEFT JOIN v_user_labels l ON l.video_id = u.video_id)
WHERE level <> 'day' OR nth <= 30""")
def usage_summary(t):
    return ledger.summary(A.usage(t), A.user_courses(t), A.user_labels(t))


@query("price_calls", "event_id long, model string, peak boolean, cost double:9",
       "SELECT event_id, model, peak, cost FROM v_usage")
def price_calls(t):
    return A.usage(t)


@query("peak_flag", "event_id long, peak boolean", "SELECT event_id, peak FROM v_calls")
def peak_flag(t):
    from lectern.functions.tariff import is_peak

    return t.events.select("event_id", is_peak(F.col("ts")).alias("peak"))


_BACKFILL = """
SELECT c.video_id, 'asr' AS kind, 'volc.bigasr.auc_turbo' AS model, c.duration_ms AS audio_ms,
       c.duration_ms / 3600000.0 * 0.8 AS cost
FROM v_user_courses c
WHERE c.duration_ms > 0 AND c.video_id IN (SELECT video_id FROM v_segments)
  AND c.video_id NOT IN (SELECT video_id FROM v_calls WHERE kind = 'signup' AND audio_ms > 150000)"""
_BACKFILL_COLS = "video_id string, kind string, model string, audio_ms long, cost double:9"


def _booked(t):
    """usage log in which long sign-ups play the speech rows"""
    long_call = (F.col("kind") == "signup") & (F.col("audio_ms") > 150000)
    return A.calls(t).withColumn("kind", F.when(long_call, "asr").otherwise(F.col("kind")))


@query("asr_backfill", _BACKFILL_COLS, _BACKFILL)
def asr_backfill(t):
    return ledger.missing_speech_rows(A.user_courses(t), A.segments(t), _booked(t))


@query("backfill_rows", "kind string, calls long, audio_ms long, cost double:9", f"""
SELECT kind, count(*) AS calls, sum(audio_ms) AS audio_ms, sum(cost) AS cost FROM (
  SELECT CASE WHEN kind = 'signup' AND audio_ms > 150000 THEN 'asr' ELSE kind END AS kind, audio_ms, CAST(NULL AS DOUBLE) AS cost FROM v_calls
  UNION ALL SELECT kind, audio_ms, cost FROM ({_BACKFILL})) GROUP BY kind""")
def backfill_rows(t):
    booked = _booked(t)
    fresh = ledger.missing_speech_rows(A.user_courses(t), A.segments(t), booked)
    whole = booked.select("kind", "audio_ms", F.lit(None).cast("double").alias("cost")).unionByName(
        fresh.select("kind", "audio_ms", "cost")
    )
    return whole.groupBy("kind").agg(
        F.count("*").alias("calls"), F.sum("audio_ms").alias("audio_ms"), F.sum("cost").alias("cost")
    )


@query("cache_rate", "video_id string, prompt_tokens long, cached_tokens long, completion_tokens long, cache_rate double", """
SELECT video_id, sum(prompt_tokens) AS prompt_tokens, sum(cached_tokens) AS cached_tokens, sum(completion_tokens) AS completion_tokens,
       CASE WHEN sum(prompt_tokens) = 0 THEN 0 ELSE sum(cached_tokens) / sum(prompt_tokens) END AS cache_rate
FROM v_calls GROUP BY video_id""")
def cache_rate(t):
    return ledger.merged_usage(A.calls(t), "video_id")
