"""Bars of an event stream: hourly sums that close once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """code (event_type), ts (hour), events and total of a streaming or static table of (ts, event_type, value)."""
    rows = events.select(F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay)
    return rows.groupBy("code", F.window("ts", "1 hour").alias("hour")).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("code", F.col("hour.start").alias("ts"), "events", "total")
