"""Streams over the event table, run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.streaming import telemetry as S


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_available(S.windowed(S.file_stream(spark, d, "events"), "ts", ["event_type"], "value"), "complete")
    return S.zoneless(out).select("window_start", "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return S.zoneless(S.run_available(S.windowed(S.file_stream(spark, d, "events"), "ts", ["event_type"], "value", "2 hours", "1 hour"), "complete")).select("window_start", "event_type", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.zoneless(S.run_available(S.sessions(S.file_stream(spark, d, "events"), "ts", ["user_id"]), "complete"))


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    events = S.file_stream(spark, d, "events")
    return S.run_available(S.once(events.unionByName(events), "ts", ["event_id"])).select("event_id", "user_id")


def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Clicks with the purchases of the same user within the hour after."""
    events = S.file_stream(spark, d, "events")
    starts = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("start_ts"))
    finishes = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("finish_ts"))
    return S.zoneless(S.run_available(S.paired(starts, finishes, "user_id")))


def stream_label_cap(spark: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.capped_labels(S.file_stream(spark, d, "events"), "event_type", "user_id"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_sessions, stream_once, stream_pairs, stream_label_cap)}

ORACLE = {
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL",
    "stream_sliding": """
        SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) t GROUP BY ALL
    """,
    "stream_sessions": """
        WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events),
        n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM n GROUP BY user_id, k
    """,
    "stream_once": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_pairs": """
        SELECT a.user_id, a.ts AS start_ts, b.ts AS finish_ts FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
    """,
    "stream_label_cap": """
        WITH c AS (SELECT event_type AS key, user_id::VARCHAR AS label, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY label) AS k FROM c)
        SELECT key, CASE WHEN k <= 16 THEN label END AS label, n FROM r
    """,
}
