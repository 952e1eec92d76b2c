"""Array and set expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_set(column: Column, missing: str = "nan") -> Column:
    """The set of values, with null as one more member."""
    return F.collect_set(F.coalesce(column.cast("string"), F.lit(missing)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; null if a side is null."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def neighbours(column: Column) -> Column:
    """Sorted distinct members."""
    return F.array_sort(F.array_distinct(column))


def chunks(column: Column, size: int, pad: Column | None = None) -> Column:
    """Arrays of ``size`` members; the last one is padded with null (or ``pad``)."""
    count = F.ceil(F.size(column) / size).cast("int")
    pad = F.lit(None) if pad is None else pad
    padded = F.concat(column, F.array_repeat(pad, size))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(padded, i * size + 1, size))
