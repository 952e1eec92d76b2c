"""Rules on shared attributes and on label rates, and score overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profiles import keyed


def attribute_rates(df: DataFrame, user: str, attribute: str, marked: Column) -> DataFrame:
    """(attribute, ratio, support): the share of marked users among the
    distinct users of each value. Distinct pairs first, so one user's many
    rows, or a hot value, shuffle once."""
    pairs = keyed(df, user, attribute).groupBy(user, attribute).agg(F.max(marked.cast("int")).alias("m"))
    return pairs.groupBy(attribute).agg(F.avg("m").alias("ratio"), F.count("*").alias("support"))


def rule_values(rates: DataFrame, ratio: float, support: int) -> DataFrame:
    return rates.where((F.col("ratio") >= ratio) & (F.col("support") >= support))


def users_with(df: DataFrame, user: str, attribute: str, values: DataFrame) -> DataFrame:
    return df.join(values.select(attribute), attribute, "left_semi").select(user).distinct()


def shared_values(df: DataFrame, attribute: str, aggregates: dict[str, Column], condition: Column) -> DataFrame:
    """Attribute values whose aggregates meet a condition."""
    return keyed(df, attribute).groupBy(attribute).agg(*(c.alias(n) for n, c in aggregates.items())).where(condition)


def overridden(scores: DataFrame, user: str, score: str, rules: Sequence[tuple[DataFrame, Column | float]]) -> DataFrame:
    """Scores with one rule after the other applied; the later one wins."""
    value = F.col(score)
    rows = scores
    for i, (users, new) in enumerate(rules):
        flag = f"_rule{i}"
        rows = rows.join(users.select(user).distinct().withColumn(flag, F.lit(True)), user, "left")
        value = F.when(F.col(flag), new).otherwise(value)
    return rows.withColumn(score, value).drop(*(f"_rule{i}" for i in range(len(rules))))


def with_limits(scores: DataFrame, score: str) -> DataFrame:
    """Adds the smallest and largest score, ``lowest`` and ``highest``, to every row."""
    return scores.join(F.broadcast(scores.agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))))


def rule_report(users: DataFrame, hits: DataFrame, user: str, marked: Column) -> DataFrame:
    """One row: hits among labelled users, marked hits, and their share."""
    rows = users.join(hits.select(user).distinct(), user, "left_semi")
    return rows.agg(F.count("*").alias("hits"), F.count_if(marked).alias("marked")).withColumn("precision", F.try_divide("marked", "hits"))
