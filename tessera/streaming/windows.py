"""Event-time windows over streams: the panel operators' counterpart where data keeps coming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], width: str, late: str, *aggs: Column, slide: str | None = None) -> DataFrame:
    """Aggregates by keys and event-time window; rows later than ``late`` are dropped and their state with them. Works on batches too."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*keys, w).agg(*aggs).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in _names(events, aggs)))


def _names(df: DataFrame, aggs: tuple[Column, ...]) -> list[str]:
    return df.groupBy().agg(*aggs).columns if aggs else []
