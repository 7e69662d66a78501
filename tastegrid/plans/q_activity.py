"""Activity queries over the request and interaction logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.operators import activity, prepare
from tastegrid.plans.context import Ctx
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import with_views
from tastegrid.sources.tables import read_table

AS_OF = dt.datetime(2024, 1, 30, 23, 0, 0)
_AS_OF_SQL = "TIMESTAMP '2024-01-30 23:00:00'"


@query("local_summary", "A18", with_views("""
SELECT COUNT(*) AS count, ROUND(COALESCE(AVG(stars), 0.0), 6) AS avg_stars FROM local_log""", "local_log"))
def local_summary(spark, sf_dir):
    out = activity.local_summary(prepare.local_log_rows(Ctx(spark, sf_dir).local_log))
    return out.select("count", F.round("avg_stars", 6).alias("avg_stars"))


@query("hourly_series", "A19", with_views(f"""
SELECT s.bucket, strftime(s.bucket, '%m-%d %H:00') AS label,
       CAST(COALESCE(l.n, 0) AS BIGINT) AS local_interactions, CAST(COALESCE(r.n, 0) AS BIGINT) AS recommend_calls
FROM (SELECT unnest(generate_series({_AS_OF_SQL} - INTERVAL 23 HOUR, {_AS_OF_SQL}, INTERVAL 1 HOUR)) AS bucket) s
LEFT JOIN (SELECT date_trunc('hour', date) AS b, COUNT(*) AS n FROM local_log
           WHERE date >= {_AS_OF_SQL} - INTERVAL 23 HOUR GROUP BY 1) l ON l.b = s.bucket
LEFT JOIN (SELECT date_trunc('hour', ts) AS b, COUNT(*) AS n FROM request_events
           WHERE ts >= {_AS_OF_SQL} - INTERVAL 23 HOUR GROUP BY 1) r ON r.b = s.bucket""", "local_log", "request_events"))
def hourly_series(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return activity.hourly_series(prepare.local_log_rows(c.local_log), c.request_events, AS_OF, 24)


@query("active_users", "A20", with_views(f"""
SELECT user_id, last_seen, source FROM (
  SELECT user_id, MAX(ts) AS last_seen, arg_max(source, (ts, source)) AS source
  FROM (SELECT user_id, ts, algorithm AS source FROM request_events WHERE ts <= {_AS_OF_SQL}) GROUP BY user_id)
WHERE last_seen >= {_AS_OF_SQL} - INTERVAL {K.ACTIVE_WINDOW_MINUTES} MINUTE""", "request_events"))
def active_users(spark, sf_dir):
    ev = Ctx(spark, sf_dir).request_events.select("user_id", "ts", F.col("algorithm").alias("source"))
    return activity.active_users(ev, AS_OF).select("user_id", "last_seen", "source")


@query("algorithm_usage", "A21", with_views(f"""
SELECT algorithm, COUNT(*) AS count FROM request_events
WHERE ts >= {_AS_OF_SQL} - INTERVAL 24 HOUR AND ts <= {_AS_OF_SQL} GROUP BY algorithm""", "request_events"))
def algorithm_usage(spark, sf_dir):
    return activity.algorithm_usage(Ctx(spark, sf_dir).request_events, AS_OF)


@query("request_latency", "A22", with_views("""
SELECT COUNT(*) AS recommend_requests, floor(COALESCE(AVG(latency_ms), 0.0) * 1000.0 + 0.5) / 1000.0 AS average_recommend_latency_ms
FROM request_events""", "request_events"))
def request_latency(spark, sf_dir):
    return activity.request_latency(Ctx(spark, sf_dir).request_events)


@query("catalog_totals", "A23", with_views("""
SELECT (SELECT COUNT(DISTINCT user_id) FROM interactions) AS total_users_with_history,
       (SELECT COUNT(*) FROM biz_prior) AS total_businesses,
       (SELECT COUNT(DISTINCT user_id) FROM local_log) AS local_user_count""", "interactions", "biz_prior", "local_log"))
def catalog_totals(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    a = c.interactions.agg(F.countDistinct("user_id").alias("total_users_with_history"))
    b = c.biz_prior.agg(F.count(F.lit(1)).alias("total_businesses"))
    d = c.local_log.agg(F.countDistinct("user_id").alias("local_user_count"))
    return a.crossJoin(b).crossJoin(d)   # three single-row aggregates


@query("event_trim", "W9", f"""
SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS algorithm, value AS latency_ms
FROM events ORDER BY ts DESC, event_id DESC LIMIT {K.MAX_EVENT_HISTORY}""")
def event_trim(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("algorithm"), F.col("value").alias("latency_ms"))
    return activity.trim_events(e)
