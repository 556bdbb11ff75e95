"""Windows over event streams. The same functions take batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_counts(events: DataFrame, at: str, keys: list[str], length: str = "1 hour", hop: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(keys, window_start, n, total) over half-overlapping windows of event time. A stream drops what is later than ``late``."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.window(at, length, hop), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(keys, session_start, session_end, n): events with less than ``gap`` between them."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_deliveries(events: DataFrame, at: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events without repeated deliveries; a stream remembers keys as long as the watermark lets them come again."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
