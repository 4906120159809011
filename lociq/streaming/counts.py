"""Windowed counts of a stream of events, and the same over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events of each type in each window. With ``late``, a stream's windows close that long after the latest event."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream(spark: SparkSession, path: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same over files as they arrive in ``path``."""
    return windowed(spark.readStream.schema(EVENT_SCHEMA).parquet(path), width, late)
