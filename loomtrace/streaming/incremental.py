"""Incremental variants on Structured Streaming: windows and sessions over events, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtrace.operators import graph as G


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream of events with a proper event time."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, event_type, n, total) per window; rows later than ``late`` are dropped, state is bounded by it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): the streaming form of gap sessions."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def upsert_into(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that upserts into versioned parquet folders; a batch that is run again changes nothing.

    Version n+1 is version n merged with the batch, last write wins. The version is the batch id, so a
    retried batch overwrites its own folder only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = G.upsert_last(batch, keys, [F.col(c) for c in order])
        if batch_id > 0:
            old = spark.read.parquet(f"{path}/v={batch_id - 1}").drop("v")
            new = G.upsert_last(old.unionByName(new), keys, [F.col(c) for c in order])
        new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return run


def start_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(upsert_into(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
