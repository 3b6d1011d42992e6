"""Operators that take a stream or a table alike: windowed counts under a watermark, and repeats within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Per window and key: rows and the sum of a value; on a stream, windows close ``late`` behind the newest event."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    counts = timed.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n", "total")


def without_repeats(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """First row per keys; on a stream, within the watermark, so that the state stays bounded."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)
