"""Structured Streaming forms of availability and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def available_only(stream: DataFrame, event: str, known: str, cutoff_minutes: int, late: str) -> DataFrame:
    """Rows that were known within so many minutes of their event, with a watermark on event time for `late` rows."""
    on_time = F.col(known).cast("long") <= F.col(event).cast("long") + 60 * cutoff_minutes
    return stream.withWatermark(event, late).filter(on_time)


def session_clusters(stream: DataFrame, keys: list[str], event: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key, closed once the watermark has passed them."""
    return stream.withWatermark(event, late).groupBy(*keys, F.session_window(event, gap).alias("w")).agg(F.count("*").alias("events"))


def sliding_sums(stream: DataFrame, keys: list[str], event: str, value: str, width: str, step: str, late: str) -> DataFrame:
    return stream.withWatermark(event, late).groupBy(*keys, F.window(event, width, step).alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("events"))
