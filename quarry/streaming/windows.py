"""Tumbling, sliding and session windows; the same plan for a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, size: str, keys: list[str], slide: str | None = None, late: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """start, keys, n, total of each window. ``late``: how long a stream waits for late rows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    grouped = rows.groupBy(F.window(time, size, slide or size).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def event_sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None, time: str = "ts") -> DataFrame:
    """start, end, keys, n of each run of events not more than ``gap`` apart."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
