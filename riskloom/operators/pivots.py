"""Counts and aggregates by category, one column per category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profiles import keyed


def count_by(df: DataFrame, keys: Sequence[str], column: str, names: Mapping[object, str]) -> DataFrame:
    """Per key: rows of each listed value (0 if none). Other values, and null, have no column.

    One conditional aggregation, so the categories need no extra pass and a
    missing one cannot shift the others.
    """
    return keyed(df, *keys).groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(n) for v, n in names.items()))


def aggregate_by(df: DataFrame, key: str, column: str, names: Mapping[object, str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Per key and listed value: the aggregates, as ``<name>_<aggregate>``; null where there is no row."""
    pivoted = keyed(df, key).groupBy(key).pivot(column, list(names)).agg(*(c.alias(n) for n, c in aggregates.items()))
    one = len(aggregates) == 1
    return pivoted.select(key, *(F.col(f"`{v}`" if one else f"`{v}_{n}`").alias(f"{name}_{n}") for v, name in names.items() for n in aggregates))
