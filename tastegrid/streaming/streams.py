"""Structured Streaming jobs over append-only logs (ST1-ST5).

Sources are file streams (new Parquet/JSON files in a folder are new data);
event time is cast from TIMESTAMP_NTZ to TIMESTAMP because watermarks need
the latter.  Windowed aggregates run in update mode: every micro-batch writes the
windows that it changed, open ones too, and readers take the latest row of
each key; the watermark only bounds the state.  ``run_available_now`` drives an
append-only query, ``run_updates`` a windowed one to completion with
``Trigger.AvailableNow`` (sink and checkpoint in the shared checkpoint folder)
and returns what it wrote as a batch DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.exprs import clamp_rating, json_key, round_half_up
from tastegrid.session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A file stream over one driver table (the folder's matching files are the stream)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("basePath", sf_dir.rstrip("/"))
            .option("maxFilesPerTrigger", 64).parquet(path[:-1] + "[" + path[-1] + "]"))


def with_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def _window_cols(w: str = "window") -> list:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


def ingest(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """ST1: purchase events -> validated local interactions, restricted to the catalogue (stream-static join)."""
    rows = (events.filter(F.col("event_type") == "purchase")
            .select(F.col("user_id").cast("string").alias("user_id"), json_key("props", "k").alias("business_id"),
                    clamp_rating(F.col("value") / 20.0).alias("stars"), F.col("ts").alias("date"),
                    F.lit("local").alias("source"))
            .dropna(subset=["user_id", "business_id", "stars"]))
    return rows.join(catalogue.select("business_id"), "business_id", "left_semi")


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST2: tumbling one-hour counts per event type."""
    e = with_event_time(events).withWatermark("ts", delay)
    return (e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
            .select(*_window_cols(), "event_type", "n"))


def active_users(events: DataFrame, minutes: int = 20, slide_minutes: int = 5) -> DataFrame:
    """ST3: users seen in each sliding 20-minute window (every 5 minutes), with their last event time."""
    e = with_event_time(events).withWatermark("ts", f"{minutes} minutes")
    return (e.groupBy(F.window("ts", f"{minutes} minutes", f"{slide_minutes} minutes"),
                      F.col("user_id").cast("string").alias("user_id"))
            .agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
            .select(*_window_cols(), "user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_events"))


def usage(events: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """ST4: requests per algorithm over sliding 24-hour windows, advancing hourly."""
    e = with_event_time(events).withWatermark("ts", delay)
    return (e.groupBy(F.window("ts", f"{hours} hours", "1 hour"), F.col("event_type").alias("algorithm"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(*_window_cols(), "algorithm", "count"))


def latency(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST5: request count and mean latency per algorithm and hour."""
    e = with_event_time(events).withWatermark("ts", delay)
    return (e.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("algorithm"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg_latency_ms"))
            .select(*_window_cols(), "algorithm", "count", round_half_up(F.col("avg_latency_ms"), 3).alias("avg_latency_ms")))


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Run a streaming DataFrame over everything available, then read its sink back (batch)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    root = f"{base}/tastegrid-streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.outputMode(output_mode).format(fmt)
         .option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint")
         .queryName(f"{name}_{uuid.uuid4().hex[:8]}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = df.schema
    return spark.read.schema(schema).format(fmt).load(f"{root}/data")


def run_updates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a windowed streaming DataFrame in update mode; the latest row of each key (batch).

    A micro-batch that runs again overwrites its own folder, so nothing is counted twice.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    root = f"{base}/tastegrid-streams/{name}-{uuid.uuid4().hex}"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", f"{root}/checkpoint").queryName(f"{name}_{uuid.uuid4().hex[:8]}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data/batch=*")
    rest = [c for c in df.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def run_log(stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """ST1 + S14: a log stream (``files.log_stream``) to its end; (rows, bad lines), both read back as tables.

    Lines that are no row go to a side output with their text.  A micro-batch that runs again overwrites its own folders.
    """
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tastegrid-streams/{name}-{uuid.uuid4().hex}"
    names = [c for c in stream.columns if c != "bad"]

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("bad IS NULL").select(*names).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        batch.where("bad IS NOT NULL").select("bad").write.mode("overwrite").parquet(f"{root}/bad/batch={batch_id}")
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{root}/checkpoint").queryName(f"{name}_{uuid.uuid4().hex[:8]}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return tuple(spark.read.schema(stream.select(*cols).schema).option("basePath", f"{root}/{part}").parquet(f"{root}/{part}")
                 for part, cols in (("rows", names), ("bad", ["bad"])))
