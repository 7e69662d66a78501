"""Streaming queries (ST1-ST5), run to completion with availableNow and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tastegrid.functions.exprs import round6
from tastegrid.plans.context import Ctx
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import with_views
from tastegrid.operators import prepare
from tastegrid.session import ensure_checkpoint_dir
from tastegrid.sources import files
from tastegrid.streaming import streams

@query("stream_ingest", "ST1, S13, S14", with_views("""
SELECT user_id, business_id, ROUND(stars, 6) AS stars, date, source FROM local_log
WHERE business_id IN (SELECT business_id FROM catalogue)""", "local_log", "catalogue"))
def stream_ingest(spark, sf_dir):
    """The interaction log as JSON lines, with broken and blank ones between them, read as a stream."""
    c = Ctx(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    files.append_log(c.local_log, path)
    views = c.request_events.where("algorithm = 'view'")
    views.select(F.concat(F.lit('{"user_id": "'), "user_id", F.when(F.col("latency_ms") > 50, F.lit('", "stars"')).otherwise(F.lit("\n\n")))).write.mode("append").text(path)
    rows, _ = streams.run_log(files.log_stream(spark, path), "ingest")
    out = prepare.local_log_rows(rows, c.catalogue)
    return out.select("user_id", "business_id", round6("stars").alias("stars"), F.col("date").cast("timestamp_ntz").alias("date"), "source")


@query("stream_hourly", "ST2", """
SELECT window_start, window_end, event_type, n FROM (
  SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
         event_type, COUNT(*) AS n FROM events GROUP BY 1, 2, 3)""")
def stream_hourly(spark, sf_dir):
    return streams.run_updates(streams.hourly_counts(streams.table_stream(spark, sf_dir, "events")), "hourly",
                               ["window_start", "window_end", "event_type"])


@query("stream_active", "ST3", """
SELECT window_start, window_end, user_id, MAX(ts) AS last_seen, COUNT(*) AS n_events FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start,
         time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE + INTERVAL 20 MINUTE AS window_end,
         CAST(user_id AS VARCHAR) AS user_id, ts
  FROM events, (SELECT unnest(range(0, 4)) AS k))
GROUP BY 1, 2, 3""")
def stream_active(spark, sf_dir):
    return streams.run_updates(streams.active_users(streams.table_stream(spark, sf_dir, "events")), "active",
                               ["window_start", "window_end", "user_id"])


@query("stream_usage", "ST4", """
SELECT window_start, window_end, algorithm, COUNT(*) AS count FROM (
  SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start,
         date_trunc('hour', ts) - k * INTERVAL 1 HOUR + INTERVAL 24 HOUR AS window_end, event_type AS algorithm
  FROM events, (SELECT unnest(range(0, 24)) AS k))
GROUP BY 1, 2, 3""")
def stream_usage(spark, sf_dir):
    return streams.run_updates(streams.usage(streams.table_stream(spark, sf_dir, "events")), "usage",
                               ["window_start", "window_end", "algorithm"])


@query("stream_latency", "ST5", """
SELECT window_start, window_end, algorithm, count, avg_latency_ms FROM (
  SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
         event_type AS algorithm, COUNT(*) AS count, floor(AVG(value) * 1000.0 + 0.5) / 1000.0 AS avg_latency_ms
  FROM events GROUP BY 1, 2, 3)""")
def stream_latency(spark, sf_dir):
    return streams.run_updates(streams.latency(streams.table_stream(spark, sf_dir, "events")), "latency",
                               ["window_start", "window_end", "algorithm"])
