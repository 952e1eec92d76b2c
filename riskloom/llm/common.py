"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as decimal text, modulo ``modulus`` (null stays null)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` marked for broadcast if they are ``most`` bytes of JSON at most;
    else as they are, for a shuffled join.  They are read once for this, so
    they should be a written table."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(rows) if (size or 0) <= most else rows
