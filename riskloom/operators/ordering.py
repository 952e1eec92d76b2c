"""Running totals over one global order, without one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.storage import materialise


def with_running(df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, Column]) -> DataFrame:
    """Adds running sums, each row included, over the given order, which must be unique.

    Rows are cut into ranges of the order and written once (the ranges come
    from a sample, which differs from run to run); each range adds the sums of
    the ranges before it, one row per range, to its own running sums.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in totals.items()))
    offsets = sums.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in totals))
    running = rows.withColumns({n: F.sum(c).over(own) for n, c in totals.items()})
    return running.join(F.broadcast(offsets), "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop("_part", *(f"_{n}" for n in totals))
