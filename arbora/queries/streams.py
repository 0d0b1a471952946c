"""Windowed queries on events; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.io import table
from arbora.streaming import events as E


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hopping(spark, folder):
    h = E.hopping(_events(spark, folder), "1 hour", "30 minutes")
    return h.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, folder):
    s = E.sessions(_events(spark, folder), "30 minutes")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {"stream_hopping": stream_hopping, "stream_sessions": stream_sessions}
SQL = {
    "stream_hopping": """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
      FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s, event_type""",
    "stream_sessions": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
      SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, k""",
}
