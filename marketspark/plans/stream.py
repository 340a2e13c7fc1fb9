"""The streaming operators on the captured events as a batch; tests hold the streams against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.plans.registry import query
from marketspark.sources.tables import table
from marketspark.streaming import events as E


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return E.tumbling(events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("stream_sliding", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INTEGER) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events, range(6) t(k) GROUP BY 1, 2")
def _(spark, d):
    return E.sliding(events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    return E.sessions(events(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_alerts", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.2")
def _(spark, d):
    return E.alerts(events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))
