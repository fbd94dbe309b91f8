"""Streams: the batch expressions run unchanged on them; these add windows and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total for each window; works on a stream (with a watermark) and on a table alike."""
    e = watermarked(events, late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n: runs of a user's events with no longer pause than `gap`."""
    e = watermarked(events, late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def new_paragraphs(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of a stream (ts, text) whose text wasn't seen within the watermark."""
    return stream.withWatermark("ts", late).withColumn("key", F.sha2(F.lower("text"), 256)).dropDuplicatesWithinWatermark(["key"])
