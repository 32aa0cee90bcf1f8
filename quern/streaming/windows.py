"""Event-time windows and duplicates over a stream of events. All of these work on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a time zone


def _counted(events: DataFrame, window: Column, late: str, *by: str) -> DataFrame:
    found = _timed(events, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "value")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; events that come later than ``late`` are dropped."""
    return _counted(events, F.window("ts", width), late, "event_type").drop("end")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """The same by windows that overlap: one starts each ``step``."""
    return _counted(events, F.window("ts", width, step), late, "event_type")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events and their value by user and session, which ends where nothing comes for longer than ``gap``."""
    return _counted(events, F.session_window("ts", gap), late, "user_id")


def without_repeats(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "1 hour") -> DataFrame:
    """One event of those with the same keys; a stream remembers them until the watermark has passed them."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if timed.isStreaming else timed.dropDuplicates(list(keys))
