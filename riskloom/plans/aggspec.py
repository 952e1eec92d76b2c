"""Declarative two-level features, compiled into few aggregations.

A spec says: of the rows that meet a filter, aggregate a column by (user,
keys), then take max, min and mean of that per user.  All specs with the same
keys become one aggregation by (user, keys) and one by user on top of it,
those of distinct values one for each column; filters turn into conditions
inside the aggregates.  A group without a row
that meets the filter must not count in the second step, so aggregates that
would be zero there are null instead.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.aggregates import STATS
from riskloom.operators.profiles import keyed
from riskloom.sources.storage import materialise

ROLLUPS = ("max", "min", "mean")


@dataclass(frozen=True)
class AggSpec:
    """``where`` is a SQL condition; ``label`` stands for the aggregate in the
    column's name, as does ``agg`` without it."""

    keys: tuple[str, ...]
    select: str
    agg: str
    where: str | None = None
    label: str | None = None

    def name(self, user: str) -> str:
        return "_".join([user, *self.keys, self.label or self.agg, self.select])

    def column(self) -> Column:
        met = F.expr(self.where) if self.where else None
        value = F.col(self.select) if met is None else F.when(met, F.col(self.select))
        out = STATS[self.agg](value)
        if met is not None and self.agg in ("count", "sum"):
            out = F.when(F.count_if(met) > 0, out)
        return out


def _counted(rows: DataFrame, user: str, keys: Sequence[str], column: str, specs: Sequence[AggSpec]) -> DataFrame:
    """Distinct counts and modes of one column under several conditions, from
    one count of (user, keys, value) with a number for each condition; no row
    is multiplied.  A mode is null where a group has one distinct value only."""
    conditions = list(dict.fromkeys(s.where for s in specs))
    if all(conditions):
        rows = rows.where(" or ".join(f"({c})" for c in conditions))
    numbers = {c: f"_n{i}" for i, c in enumerate(conditions)}
    counts = rows.groupBy(user, *keys, F.col(column).alias("_v")).agg(*(F.count_if(F.expr(c or "true")).alias(n) for c, n in numbers.items()))
    out = []
    for s in specs:
        n, v = F.col(numbers[s.where]), F.col("_v").cast("double")
        held = F.col("_v").isNotNull() & (n > 0)
        if s.agg == "mode":
            value = F.when(F.count_if(held) > 1, F.max_by(F.when(held, v), F.when(held, F.struct(n, -v))))
        else:
            value = F.when(F.sum(n) > 0, F.count_if(held))
        out.append(value.alias(s.name(user)))
    return counts.groupBy(user, *keys).agg(*out)


def _rolled(inner: DataFrame, user: str, names: Sequence[str]) -> DataFrame:
    """(user, values): the max, min and mean of each name."""
    return inner.groupBy(user).agg(F.array(*(STATS[r](F.col(n)).cast("double") for n in names for r in ROLLUPS)).alias("values"))


def compile_specs(df: DataFrame, user: str, specs: Sequence[AggSpec], written: bool = True) -> DataFrame:
    """One row per user of ``df``, all values as doubles; null where a user has
    no group for a spec.

    ``written``: the rows are written once to the shared folder, so that each
    set of keys reads just its columns, and windows below are not computed
    again for every set, and the values of all sets are written long, so that
    the wide aggregation by user is planned once.
    """
    df = materialise(df, "spec-rows") if written else df
    by_keys: dict[tuple[tuple[str, ...], str | None], list[AggSpec]] = defaultdict(list)
    for s in specs:
        by_keys[s.keys, s.select if s.agg in ("mode", "nunique") else None].append(s)
    frames, names = [keyed(df, user).select(user).distinct().withColumn("values", F.lit(None).cast("array<double>"))], [[]]
    for (keys, column), own in by_keys.items():
        rows = keyed(df, user, *keys)
        inner = _counted(rows, user, keys, column, own) if column else rows.groupBy(user, *keys).agg(*(s.column().alias(s.name(user)) for s in own))
        names.append([s.name(user) for s in own])
        frames.append(_rolled(inner, user, names[-1]))
    long = reduce(DataFrame.unionAll, (f.select(user, F.lit(i).alias("_frame"), "values") for i, f in enumerate(frames)))
    long = materialise(long, "spec-values") if written else long
    wide = long.groupBy(user).agg(*(F.max(F.when(F.col("_frame") == i, F.col("values"))).alias(f"_{i}") for i in range(1, len(frames))))
    columns = [F.get(f"_{i}", F.lit(j)).alias(n) for i, own in enumerate(names) for j, n in enumerate(f"{n}_{r}" for n in own for r in ROLLUPS)]
    return wide.select(user, *columns)


@dataclass(frozen=True)
class RatioSpec:
    """The user's row count on an attribute value against the value's mean and sum over users."""

    attribute: str

    def measures(self, df: DataFrame, user: str) -> DataFrame:
        counts = keyed(df, user, self.attribute).groupBy(user, self.attribute).agg(F.count("*").alias("n"))
        totals = counts.groupBy(self.attribute).agg(F.avg("n").alias("m"), F.sum("n").alias("s"))
        rows = counts.join(totals, self.attribute)
        a = self.attribute
        parts = {f"{a}_mean": F.col("m"), f"{a}_sum": F.col("s").cast("double"), f"{a}_user_to_mean": F.col("n") / F.col("m"), f"{a}_user_to_sum": F.col("n") / F.col("s")}
        return rows.groupBy(user).agg(*(STATS[r](c).alias(f"{n}_{r}") for n, c in parts.items() for r in ROLLUPS))


def compile_ratios(df: DataFrame, user: str, specs: Sequence[RatioSpec]) -> DataFrame:
    out = keyed(df, user).select(user).distinct()
    for s in specs:
        out = out.join(s.measures(df, user), user, "left")
    return out


# The keys, columns, limits and names of the features below are given.
def event_specs() -> list[AggSpec]:
    """The specs on all actions: spread, counts, and what happens close together or early in the month."""
    out = [AggSpec(k, "day", "var") for k in (("device2", "channel"), ("ip", "channel"), ("device2", "ip"), ("version", "channel"))]
    out += [AggSpec(k, "hour", "var") for k in (("ip", "version"), ("device2", "ip"), ("device2", "os"), ("day", "channel"))]
    groups = (("day", "hour"), ("device2",), ("device2", "os"), ("device2", "day", "hour"))
    out += [AggSpec(k, "channel", "count") for k in groups]
    out.append(AggSpec(("device2", "channel"), "hour", "mean"))
    near = "time_diff_secd < 5"
    out += [AggSpec(k, "channel", "count", near, "var_ude5") for k in groups]
    out.append(AggSpec(("device2", "channel"), "hour", "mean", near, "var_ude5"))
    out += [AggSpec(k, "is_oper", "mean", near, "var_ude5") for k in groups]
    near = "time_diff_secd < 10"
    out += [AggSpec(k, "time_diff_secd", "nunique", near, "var_ude10") for k in groups]
    days = (("day", "hour"), ("hour",), ("day",))
    out += [AggSpec(k, "device_code", "nunique", near, "var_ude10") for k in days]
    for day in (10, 20, 32):
        early, label = f"day < {day}", f"var_dayude{day}"
        out += [AggSpec(k, "merchant", "nunique", early, label) for k in days]
        out += [AggSpec(k, "hour", "nunique", early, label) for k in (("day", "merchant"), ("merchant",), ("day",))]
    for key in ("device2", "day", "ip", "os", "wifi", "market_code"):
        out += [AggSpec((key,), "time_diff_secd", agg, f"time_diff_secd < {s}", f"{agg}_ude{s}") for agg in ("var", "sum") for s in (600, 300)]
    return out


def payment_specs() -> list[AggSpec]:
    """The specs on payments: how balance and amount move by day, hour and channel."""
    out = [
        AggSpec((key,), column, agg, f"{column} > 0", "mod" if agg == "mode" else None)
        for column in ("bal_increase", "bal_difabs", "trans_amt_increase", "trans_amt_difabs")
        for key in ("day", "hour", "channel") for agg in ("var", "mean", "mode", "nunique")
    ]
    return out + [AggSpec((key,), "bal_decrease2amt", agg, "bal_decrease2amt > 0") for key in ("day", "hour", "channel") for agg in ("var", "mean")]
