"""Popularity over a stream of events, kept up incrementally per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window start, key, n): works on a stream (rows later than ``late`` are left out) and on a table alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if e.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")
