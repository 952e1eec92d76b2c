"""Order-dependent operators. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.times import gap_seconds

LAST_GAP = 99_999


def _order(key: str | Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def lag_difference(df: DataFrame, key: str, order: Sequence[str], column: str, name: str, n: int = 1) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column, n).over(_order(key, order)))


def lead_gap(df: DataFrame, key: str, order: Sequence[str], micros: str, name: str, within_day: bool = True) -> DataFrame:
    """Whole seconds to the key's next row; ``LAST_GAP`` at the last one."""
    ahead = F.lead(micros).over(_order(key, order))
    return df.withColumn(name, F.coalesce(gap_seconds(F.col(micros), ahead, within_day), F.lit(LAST_GAP)))


def sessions(df: DataFrame, key: str, order: Sequence[str], micros: str, name: str, limit: int = 600, within_day: bool = True) -> DataFrame:
    """Session numbers from 0: a gap over ``limit`` seconds after a row ends its session."""
    rows = lead_gap(df, key, order, micros, "_gap", within_day)
    ends = (F.col("_gap") > limit).cast("int")
    before = _order(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(ends).over(before), F.lit(0))).drop("_gap")


def cumulative_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(_order(keys, order)) - 1)


def average_rank(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Rank in ascending order, with the mean rank for ties."""
    ties = F.count("*").over(Window.partitionBy(key, column))
    return df.withColumn(name, F.rank().over(Window.partitionBy(key).orderBy(column)) + (ties - 1) / 2)


def fill_forward(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = _order(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_backward(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = _order(key, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def change_flags(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], n: int = 1) -> DataFrame:
    """``<column>_changed``: 1 where the value differs from the one ``n`` rows before (null equals null)."""
    w = _order(key, order)
    return df.withColumns({f"{c}_changed": (~F.col(c).eqNullSafe(F.lag(c, n).over(w))).cast("int") for c in columns})


def change_stats(df: DataFrame, key: str, order: Sequence[str], micros: str, columns: Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """Per key: sum and mean of the change flags, over all rows and over those
    that follow their predecessor within each limit (in minutes)."""
    rows = change_flags(df, key, order, columns).withColumn("_minutes", (F.col(micros) - F.lag(micros).over(_order(key, order))) / 60_000_000)
    aggregates = []
    for c in columns:
        flag = F.col(f"{c}_changed")
        for name, within in ({"all": F.lit(True)} | {n: F.col("_minutes") <= m for n, m in limits.items()}).items():
            aggregates += [F.coalesce(F.sum(F.when(within, flag)), F.lit(0)).alias(f"{c}_changed_{name}_sum"), F.avg(F.when(within, flag)).alias(f"{c}_changed_{name}_mean")]
    return rows.groupBy(key).agg(*aggregates)


def trailing_counts(df: DataFrame, key: str, micros: str, seconds: Sequence[int], measures: Mapping[str, Column]) -> DataFrame:
    """Per key and window length: rows that meet each condition in the last
    seconds before the key's last row."""
    last = F.max(micros).over(Window.partitionBy(key))
    rows = df.withColumn("_before", (last - F.col(micros)) / 1_000_000)
    return rows.groupBy(key).agg(
        *(F.count_if(c & (F.col("_before") <= s)).alias(f"{name}_{s}") for s in seconds for name, c in measures.items())
    )


def transition_score(df: DataFrame, key: str, order: Sequence[str], micros: str, first: Column, second: Column, name: str, limit: float = 100.0) -> DataFrame:
    """Over the pairs of a ``first`` row and the next row of either kind, if
    that is a ``second``: how many follow within ``limit`` seconds, over the
    sum of their seconds plus one. Zero without pairs."""
    users = df.select(key).distinct()
    rows = df.where(first | second).withColumn("_first", first)
    w = _order(key, order)
    rows = rows.withColumns({"_after": F.lag("_first").over(w), "_span": (F.col(micros) - F.lag(micros).over(w)) / 1_000_000})
    pairs = rows.where(F.col("_after") & ~F.col("_first"))
    scores = pairs.groupBy(key).agg((F.count_if(F.col("_span") <= limit) / (F.sum("_span") + 1.0)).alias(name))
    return users.join(scores, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
