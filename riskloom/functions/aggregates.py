"""Aggregate expressions, each with the meaning that feature tables need."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum0(c: Column) -> Column:
    """Zero, not null, for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0))


def skew(c: Column) -> Column:
    """Bias-corrected skewness: null below three values, zero for equal ones."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(F.count(c) >= 3, F.when(F.max(c) == F.min(c), 0.0).otherwise(corrected))


STATS = {
    "count": F.count,
    "nunique": F.count_distinct,
    "sum": sum0,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "skew": skew,
}


def stats(column: str, names: Iterable[str], prefix: str | None = None, of: Column | None = None) -> list[Column]:
    """Aggregates of a column, named ``<prefix>_<stat>``."""
    return [STATS[n](F.col(column) if of is None else of).alias(f"{prefix or column}_{n}") for n in names]


def first_by(value: Column, order: Column) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_by(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def ordered_list(value: Column, *order: Column) -> Column:
    """Values in order, as an array; nulls stay."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.transform(rows, lambda r: r["_value"])
