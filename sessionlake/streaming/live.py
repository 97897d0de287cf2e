"""Streams of events: windowed tool counts, session windows, and a sink that merges into the store.

Beyond the batch reports; each has a batch counterpart that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import Store, sessions_of
from ..schema import EVENT_SCHEMA


def event_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Events that arrive as Parquet files of EVENT_SCHEMA."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1000).cast("long")))


def windowed_tool_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls of each tool in each window; rows later than `late` are left out by the watermark."""
    calls = timed(events).filter((F.col("event_type") == "tool_call") & F.col("tool_name").isNotNull())
    counted = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool_name").agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").alias("window_start"), "tool_name", "cnt")


def activity_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity of each session: events with less than `gap` between them."""
    grouped = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("events"))
    return grouped.select("session_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def merge_into(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch into the store. A batch that is tried again replaces its own rows, so nothing counts twice."""
    store.create()

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        touched = batch.select("source", "session_id").distinct()
        files = batch.groupBy("source_file").agg(F.max(F.col("timestamp") / 1000.0).alias("mtime"), F.lit(None).cast("string").alias("project_path"), F.lit(None).cast("string").alias("metadata"))
        # a session's span covers what the store has of it already
        known = store.events().join(touched, ["source", "session_id"], "left_semi")
        both = known.unionByName(batch.select(*EVENT_SCHEMA.names))
        none = spark.createDataFrame([], "source_key string, mtime double, size long")
        store.merge(batch.select(*EVENT_SCHEMA.names), sessions_of(both, files), none)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
