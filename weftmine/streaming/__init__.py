"""Incremental input: long tables arriving as a stream, counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_counts(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Window start, item, n for a stream (ts, pid, item): occurrences by window, dropped from state once ``late`` behind."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "item").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "item", "n")
