"""Tables of the driver, and event rows under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.times import micros


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as actions: purchases are payments (action_type 2), the rest operations (1).

    Attributes with nulls stand in for shared ids: ``ip`` (wide) and ``dev`` (narrow).
    """
    k = F.get_json_object("props", "$.k").cast("int")
    mode = F.col("event_type")
    return load(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("uid"), "ts", micros(F.col("ts")).alias("us"), "value", mode.alias("mode"),
        F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"), k.alias("k"),
        F.nullif(k, F.lit(0)).alias("ip"), F.nullif(k % 7, F.lit(0)).alias("dev"),
        F.when(mode == "purchase", 2).otherwise(1).alias("action_type"),
        F.when(mode == "error", 0).when(mode == "signup", -1).otherwise(1).alias("success"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as payments with a user, a merchant and an account."""
    lines, orders = load(spark, folder, "lineitem"), load(spark, folder, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("uid"), F.col("l_suppkey").alias("merchant"), F.col("l_partkey").alias("account"), F.col("o_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("line"), F.col("o_orderpriority").alias("channel"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("market"),
        F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), F.dayofmonth("l_shipdate").alias("day"), F.col("l_shipdate").alias("shipped"), F.col("o_orderdate").alias("ordered"),
    )
