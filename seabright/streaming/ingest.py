"""Incremental ping index: pings that arrive as Parquet files are summed per band in event-time windows.

The reference is batch only; this is the same band summary kept up to date by Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_counts(pings: DataFrame, lateness: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """window, subsystem, pings, f0 and f1 ranges of a stream (or table) of pings with an event time ``ts``."""
    rows = pings.withWatermark("ts", lateness) if pings.isStreaming else pings
    return rows.groupBy(F.window("ts", window).alias("w"), "subsystem").agg(
        F.count("*").alias("pings"), F.min("f0").alias("f0"), F.max("f1").alias("f1")
    ).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "subsystem", "pings", "f0", "f1")
