"""Dates and times. The session time zone should be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def day_of_base(base: str, days: Column) -> Column:
    """The date ``days`` after ``base``, as text."""
    return F.date_format(F.date_add(F.to_date(F.lit(base)), days.cast("int")), "yyyy-MM-dd")


def at_time(base: str, days: Column, time: Column) -> Column:
    """The moment ``days`` after ``base`` at a time HH:MM:SS; null if either is null or unreadable."""
    return F.try_to_timestamp(F.concat_ws(" ", day_of_base(base, days), F.when(days.isNotNull(), time)), F.lit("yyyy-MM-dd HH:mm:ss"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def hour_of_text(time: Column) -> Column:
    return F.substring(time, 1, 2).try_cast("int")


def gap_seconds(a: Column, b: Column, within_day: bool = True) -> Column:
    """Whole seconds between two microsecond stamps; ``within_day`` drops whole days."""
    gap = F.floor(F.abs(b - a) / 1_000_000)
    return F.pmod(gap, F.lit(86_400)) if within_day else gap
