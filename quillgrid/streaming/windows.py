"""Event-time windows over the events table as a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed(events: DataFrame, length: str = "1 hour", late: str = "30 days") -> DataFrame:
    """window_start, event_type, events, total of a stream of events; rows later than late are dropped by the watermark."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads all events as a stream with what is there now, and returns the final windows. Each batch replaces the windows it changes: the last version of a window counts."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_streams")
    folder = os.path.join(shared, f"stream-{uuid.uuid4().hex}")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    query = windowed(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("events", "total"), "batch").alias("x"))
    return last.select("window_start", "event_type", "x.events", "x.total")
