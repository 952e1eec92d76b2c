"""Measures of ranked scores, as one sort and a few aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import with_running

TARGETS = ((0.001, 0.4), (0.005, 0.3), (0.01, 0.3))


def cumulative(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Rows in descending score with their place (from 1) and the marked rows so far."""
    rows = df.select(F.col(score).alias("score"), F.col(label).cast("long").alias("label"), F.col(tie).alias("tie"))
    return with_running(rows, [F.desc("score"), "tie"], {"place": F.lit(1), "marked": F.col("label")})


def weighted_tpr(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """One row: 0.4, 0.3 and 0.3 times the true-positive rate where the
    false-positive rate is nearest to 0.001, 0.005 and 0.01 (the first place, on ties)."""
    rows = cumulative(df, score, label, tie)
    totals = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    rates = rows.join(F.broadcast(totals)).select(
        "place", F.try_divide(F.col("marked"), F.col("p")).alias("tpr"), F.try_divide(F.col("place") - F.col("marked"), F.col("n") - F.col("p")).alias("fpr")
    )
    parts = [F.min_by("tpr", F.struct(F.abs(F.col("fpr") - t), "place")) * w for t, w in TARGETS]
    return rates.agg((parts[0] + parts[1] + parts[2]).alias("weighted_tpr"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve, from counts per distinct score."""
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ranked = with_running(by, ["score"], {"upto": F.col("n") - F.col("p")}).withColumn("less", F.col("upto") - (F.col("n") - F.col("p")))
    pairs = F.sum(F.col("p") * (F.col("less") + (F.col("n") - F.col("p")) / 2))
    return ranked.agg(F.try_divide(pairs, (F.sum("p") * F.sum(F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def log_loss(df: DataFrame, probability: str, label: str) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))
