"""Sessions, window counts and popularity on event streams.

Batch frames work as well. Streams need a watermark, so state is bounded:
late rows beyond it are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "600 seconds", delay: str = "1 hour") -> DataFrame:
    """(key, start, end, rows) of sessions that a gap ends."""
    rows = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("rows"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def window_counts(events: DataFrame, key: str, ts: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, start, end, rows) of tumbling windows, or sliding ones with ``slide``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    rows = events.withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("rows"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def popularity(events: DataFrame, attribute: str, user: str, ts: str, length: str, delay: str = "1 hour") -> DataFrame:
    """(attribute, start, users): about how many users share a value in a window."""
    rows = events.withWatermark(ts, delay).groupBy(attribute, F.window(ts, length).alias("w")).agg(F.approx_count_distinct(user).alias("users"))
    return rows.select(attribute, F.col("w.start").alias("start"), "users")
