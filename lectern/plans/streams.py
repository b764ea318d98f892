"""Streaming queries: the shared files are read as a stream, run to the end, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import ledger
from lectern.plans import adapters as A
from lectern.plans.registry import Tables, query
from lectern.schemas import TABLES
from lectern.session import work_path
from lectern.streaming import jobs


class Streams(Tables):
    """The same tables as streams. All files that are there make one micro-batch: they are in no order of time, and in a later
    batch the rows behind the watermark of an earlier one would be dropped."""

    def _open(self, name: str) -> DataFrame:
        # a table is a file or a folder of files; a stream takes a single file only by a pattern
        return self.spark.readStream.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parque[t]")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Write all that is there now to files and return them."""
    folder = work_path(stream.sparkSession, "stream")
    job = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start(f"{folder}/out")
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_ledger", "day string, kind string, model string, calls long, prompt_tokens long, unpriced long", """
SELECT strftime(called_at, '%Y-%m-%d') AS day, kind, model, count(*) AS calls, sum(prompt_tokens) AS prompt_tokens, count(*) FILTER (cost IS NULL) AS unpriced
FROM v_usage GROUP BY 1, 2, 3, date_trunc('day', called_at) HAVING date_trunc('day', called_at) + INTERVAL 1 DAY <= (SELECT max(called_at) FROM v_usage) - INTERVAL 1 DAY""")
def stream_ledger(t):
    s = Streams(t.spark, t.folder)
    usage = ledger.price_calls(A.calls(s)).withColumn("at", F.col("at").cast("timestamp"))
    return run_to_end(jobs.running_ledger(usage))


@query("stream_sessions", "session_id long, began_s long, ended_s long, n_messages long", """
SELECT session_id, min(created_s) AS began_s, max(created_s) + 1800 AS ended_s, count(*) AS n_messages FROM v_messages GROUP BY session_id
HAVING max(created_s) + 1800 <= (SELECT max(created_s) FROM v_messages) - 3600""")
def stream_sessions(t):
    s = Streams(t.spark, t.folder)
    m = A.messages(s).withColumn("at", F.timestamp_seconds("created_s"))
    out = run_to_end(jobs.chat_activity(m))
    return out.select("session_id", F.unix_timestamp("began").alias("began_s"), F.unix_timestamp("ended").alias("ended_s"), "n_messages")


@query("stream_replies", "reply_id long, text string, finish_reason string, total_tokens long", r"""
SELECT id AS reply_id, trim(content, chr(10) || ' ') AS text, CASE WHEN id % 4 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, len(string_split(content, ' ')) - 1 AS total_tokens
FROM v_messages WHERE created_s + 30 <= (SELECT max(created_s) FROM v_messages) - 60""")
def stream_replies(t):
    from lectern.plans import notes

    return run_to_end(jobs.live_replies(notes.deltas(A.messages(Streams(t.spark, t.folder)))))


# what lies within ten minutes of the newest event may still be overtaken: it waits, and so does the chunk before it
@query("stream_chunks", "video_id string, idx long, start_ms long, end_ms long, n_segments long", """
WITH m AS (SELECT max(ts) AS newest FROM events), u AS (SELECT 'u' || user_id AS video_id, max(ts) AS last_ts FROM events GROUP BY user_id),
o AS (SELECT video_id FROM u, m WHERE last_ts + INTERVAL 20 MINUTE > newest),
passed AS (SELECT video_id, max(idx) AS idx FROM v_chunks, m WHERE start_ms <= CAST(floor(epoch(newest - INTERVAL 10 MINUTE)) AS BIGINT) GROUP BY video_id)
---
SELECT c.video_id, c.idx, c.start_ms, c.end_ms, c.n_segments FROM v_chunks c LEFT JOIN passed p ON p.video_id = c.video_id
WHERE c.video_id NOT IN (SELECT video_id FROM o) OR c.idx < p.idx""")
def stream_chunks(t):
    s = Streams(t.spark, t.folder)
    at = s.events.select(F.col("event_id").alias("seg_id"), F.col("ts").cast("timestamp").alias("at"), "user_id", "value")
    from lectern.functions import clock

    start = clock.epoch_seconds(F.col("at").cast("timestamp_ntz"))
    rows = at.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), "at", "seg_id", start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100).cast("long")).alias("end_ms"),
    )
    # starts are whole seconds
    return run_to_end(jobs.live_chunks(rows, grain_ms=1000))
