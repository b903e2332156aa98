"""Streaming form of the histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_histogram(events: DataFrame, time: str, key: str, weight: str, size: str, late: str = "10 minutes") -> DataFrame:
    """Summed weights by key and tumbling window of event time, for a stream (or a table) with a timestamp column."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
