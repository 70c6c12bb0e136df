"""Structured Streaming forms of the counting, deduplication and session operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_events(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of a user, closed after a gap without events."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")
