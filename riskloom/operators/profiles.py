"""Aggregations per user, per entity, and from entity back to user."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.aggregates import stats


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with all keys known; groups never form around null."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def entity_profile(df: DataFrame, entity: str, aggregates: Sequence[Column]) -> DataFrame:
    """One row per entity with the given aggregates."""
    return keyed(df, entity).groupBy(entity).agg(*aggregates)


def profile_rollup(df: DataFrame, user: str, entity: str, aggregates: Sequence[Column], names: Sequence[str] = ("max", "min", "sum", "mean", "std", "skew")) -> DataFrame:
    """Profiles entities, gives each event its entity's profile, and aggregates per user.

    The join brings one row per entity to events of two columns.  Spark
    broadcasts the profiles if they are small; else it splits the events of a
    frequent entity, as the profiles' side has one row of it.
    """
    profile = entity_profile(df, entity, aggregates)
    columns = [c for c in profile.columns if c != entity]
    rows = df.select(user, entity).join(profile, entity, "left")
    out = [a for c in columns for a in stats(c, names)]
    return keyed(rows, user).groupBy(user).agg(*out)


def two_level(df: DataFrame, user: str, keys: Sequence[str], first: Mapping[str, Column], names: Sequence[str]) -> DataFrame:
    """Aggregates per (user, keys), then statistics of these per user."""
    inner = keyed(df, user, *keys).groupBy(user, *keys).agg(*(c.alias(n) for n, c in first.items()))
    return inner.groupBy(user).agg(*(a for n in first for a in stats(n, names)))


def favourite(df: DataFrame, user: str, column: str) -> DataFrame:
    """Per user the most frequent value (the largest, on ties), its count, and
    the count over all of the user's rows. One aggregation on top of counts."""
    counts = df.groupBy(user, column).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col(column).isNotNull(), F.struct("n", F.col(column).alias("v"))))
    return (
        keyed(counts, user).groupBy(user).agg(best.alias("best"), F.sum("n").alias("rows"))
        .select(
            user, F.col("best.v").alias(f"{column}_favourite"), F.coalesce("best.n", F.lit(0)).alias(f"{column}_favourite_count"),
            (F.coalesce("best.n", F.lit(0)) / F.col("rows")).alias(f"{column}_favourite_rate"),
        )
    )


def top_two(df: DataFrame, user: str, column: str) -> DataFrame:
    """The two most frequent values (the smaller first, on ties), their counts and the ratio of these."""
    counts = keyed(df, user, column).groupBy(user, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), column))
    ranked = counts.withColumn("r", rank).where("r <= 2")
    pick = {(what, r): F.max(F.when(F.col("r") == r, F.col(c))) for what, c in (("top", column), ("count", "n")) for r in (1, 2)}
    return ranked.groupBy(user).agg(
        *(c.alias(f"{column}_{what}{r}") for (what, r), c in pick.items()),
        (pick["count", 2] / pick["count", 1]).alias(f"{column}_second_ratio"),
    )


def entropy(df: DataFrame, user: str, column: str) -> DataFrame:
    """Shannon entropy in bits of a user's values."""
    counts = keyed(df, user, column).groupBy(user, column).agg(F.count("*").alias("n"))
    n, total = F.col("n"), F.sum("n")
    # H = log2(N) - sum(n log2 n) / N, in one aggregation
    return counts.groupBy(user).agg((F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total).alias(f"{column}_entropy"))


def mode_if_mixed(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The most frequent value (the smallest, on ties) where a group has two distinct values or more, else null."""
    counts = keyed(df, *keys).groupBy(*keys, column).agg(F.count("*").alias("n")).where(F.col(column).isNotNull())
    best = F.max_by(column, F.struct("n", -F.col(column)))
    return counts.groupBy(*keys).agg(F.when(F.count("*") > 1, best).alias(name))


def set_overlap(left: DataFrame, right: DataFrame, user: str, column: str, name: str) -> DataFrame:
    """Jaccard ratio of a user's value sets on two sides; null where one side has no row."""
    from riskloom.functions.arrays import overlap, value_set

    a = left.groupBy(user).agg(value_set(F.col(column)).alias("a"))
    b = right.groupBy(user).agg(value_set(F.col(column)).alias("b"))
    return a.join(b, user, "full").select(user, overlap(F.col("a"), F.col("b")).alias(name))
