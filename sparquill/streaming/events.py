"""Streams over event tables.  The batch operators have no counterpart of these;
they extend the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need (session zone UTC)."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end and n of runs of events less than ``gap`` apart.  Batch and
    stream alike; in a stream the watermark closes sessions."""
    rows = timed(events, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    found = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, however often it arrives within the watermark."""
    rows = timed(events, at)
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def windowed(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and event type."""
    rows = timed(events, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    found = rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "value")
