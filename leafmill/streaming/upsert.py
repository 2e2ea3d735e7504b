"""Incremental upkeep: entities and windowed counts from a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_updates(writes: DataFrame) -> DataFrame:
    """Running state of each entity from a stream of (key, page, confidence, ord): for update or complete mode."""
    return writes.groupBy("key").agg(
        F.array_sort(F.collect_set("page")).alias("pages"), F.max("confidence").alias("confidence"),
        F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n_writes"),
    )


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; state older than the watermark is let go."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    told = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = told.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
