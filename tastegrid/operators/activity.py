"""Activity reporting over append-only logs (A18-A23, W9), batch form.

``as_of`` is an explicit argument (the reference reads the wall clock);
timestamps are compared as written (no time zone conversion).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import round_half_up


def _ts(value: dt.datetime) -> F.Column:
    return F.lit(value).cast("timestamp_ntz")


def local_summary(log: DataFrame) -> DataFrame:
    """Count and mean stars of the local log; 0 when empty."""
    return log.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.avg("stars"), F.lit(0.0)).alias("avg_stars"))


def hourly_series(local_log: DataFrame, requests: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Per UTC hour of the last ``hours`` (clamped to 6..168) the local interactions and recommend calls.

    A generated hour spine is left-joined to both hourly counts, so empty hours show 0.
    """
    hours = max(6, min(int(hours), 168))
    now_bucket = as_of.replace(minute=0, second=0, microsecond=0)
    start = now_bucket - dt.timedelta(hours=hours - 1)
    spine = local_log.sparkSession.range(1).select(
        F.explode(F.sequence(_ts(start), _ts(now_bucket), F.expr("INTERVAL 1 HOUR"))).alias("bucket"))

    def counts(df: DataFrame, col: str, name: str) -> DataFrame:
        b = F.date_trunc("hour", F.col(col)).cast("timestamp_ntz")
        return (df.filter(F.col(col).isNotNull() & (F.col(col) >= _ts(start)))
                .groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias(name)))

    out = (spine.join(counts(local_log, "date", "local_interactions"), "bucket", "left")
           .join(counts(requests, "ts", "recommend_calls"), "bucket", "left"))
    return out.select("bucket", F.date_format("bucket", "MM-dd HH:00").alias("label"),
                      F.coalesce("local_interactions", F.lit(0)).cast("bigint").alias("local_interactions"),
                      F.coalesce("recommend_calls", F.lit(0)).cast("bigint").alias("recommend_calls"))


def active_users(events: DataFrame, as_of: dt.datetime, window_minutes: int = K.ACTIVE_WINDOW_MINUTES) -> DataFrame:
    """Users whose latest event (up to as_of) is within the window; source of that event."""
    cutoff = as_of - dt.timedelta(minutes=window_minutes)
    last = (events.filter(F.col("ts") <= _ts(as_of))
            .groupBy("user_id").agg(F.max("ts").alias("last_seen"),
                                    F.max_by("source", F.struct("ts", "source")).alias("source")))
    return last.filter(F.col("last_seen") >= _ts(cutoff))


def algorithm_usage(requests: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Request count per algorithm over the last 24 hours."""
    cutoff = as_of - dt.timedelta(hours=hours)
    return (requests.filter((F.col("ts") >= _ts(cutoff)) & (F.col("ts") <= _ts(as_of)))
            .groupBy("algorithm").agg(F.count(F.lit(1)).alias("count")))


def request_latency(requests: DataFrame) -> DataFrame:
    """Number of requests and mean latency in ms rounded to 3 decimals (0 when none)."""
    return requests.agg(F.count(F.lit(1)).alias("recommend_requests"),
                        round_half_up(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 3).alias("average_recommend_latency_ms"))


def trim_events(requests: DataFrame, keep: int = K.MAX_EVENT_HISTORY) -> DataFrame:
    """The newest ``keep`` events (a top-n: one partial top-n per partition, then a merge)."""
    return requests.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(keep)


def demo_subset(users_with_history: DataFrame, local_users: DataFrame, first_n: int = 300) -> DataFrame:
    """The first ``first_n`` users in id order plus every local user."""
    first = users_with_history.select("user_id").distinct().orderBy("user_id").limit(first_n)
    return first.unionByName(local_users.select("user_id")).distinct()


def demo_ready_users(events_users: DataFrame | None, history_users: DataFrame) -> DataFrame:
    """Users having events, else users having histories; which of them is settled inside the plan."""
    histories = history_users.select("user_id").distinct()
    if events_users is None:
        return histories
    return events_users.select("user_id").distinct().union(histories.where(~events_users.select("user_id").exists()))


EVENT_BUCKETS = 64


def user_bucket(user: str = "user_id"):
    return F.pmod(F.crc32(F.col(user)), F.lit(EVENT_BUCKETS)).cast("int")


def write_events_by_user(events: DataFrame, path: str) -> None:
    """J15's layout: events in folders by a bucket of the user, so that reading some users' events opens their folders only."""
    events.withColumn("bucket", user_bucket()).write.partitionBy("bucket").parquet(path)


def events_of_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """``events`` (read from that layout) of the chosen users.

    The buckets of the chosen users come from a subquery and restrict the scan's partitions before the semi join.
    """
    chosen = users.select(F.col("user_id").alias("_u"), user_bucket().alias("_b")).distinct()
    on = (F.col("bucket") == F.col("_b")) & (F.col("user_id") == F.col("_u"))
    return events.join(chosen, on, "left_semi").drop("bucket")
