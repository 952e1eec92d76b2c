"""Boosted trees by second derivatives, with gradient-based one-side sampling."""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasValidationIndicatorCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.storage import materialise

#: Rounds between writes of the rows with their margins.
WRITTEN = 8


def _chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


class NewtonTrees(Estimator, HasValidationIndicatorCol):
    """Binary classifier from (features, label).  A round fits one tree to
    -g / h weighted by h, where g and h are the loss's two derivatives at the
    rows' margins: its leaves are Newton steps and its splits maximise the gain
    in G^2 / H, without a penalty on leaves.

    ``top`` below 1 samples rows by gradient: that share with the largest |g|
    (with all that tie) stays, of the others a share ``other`` of all rows is
    drawn and weighted up to stand for the rest.  With a validation column,
    rounds end after ``patience`` rounds without a smaller loss of its rows, and
    those after the best are dropped.  Where all rows have one label, the model
    has no trees and returns that label; for an empty table it returns one half.
    """

    def __init__(self, rounds: int = 20, depth: int = 4, rate: float = 0.1, top: float = 1.0, other: float = 0.1, patience: int = 5, seed: int = 2018):
        super().__init__()
        if top < 1 and not 0 < other <= 1 - top:
            raise ValueError("other must be over 0 and at most 1 - top")
        self.rounds, self.depth, self.rate, self.top, self.other, self.patience, self.seed = rounds, depth, rate, top, other, patience, seed

    def stopping_by(self, column: str) -> NewtonTrees:
        """Rows with ``column`` true are held out to end the rounds."""
        return self._set(validationIndicatorCol=column)

    def _fit(self, df: DataFrame) -> NewtonTreesModel:
        held = F.col(self.getValidationIndicatorCol()) if self.isDefined("validationIndicatorCol") else F.lit(False)
        y, x = F.col("label").cast("double"), vector_to_array("features")
        rows = materialise(df.select(x.alias("x"), y.alias("label"), held.alias("held")), "boosting")
        kept = ~F.col("held")
        n, ones, checked, size = rows.agg(F.count_if(kept), F.sum(F.when(kept, F.col("label"))), F.count_if("held"), F.max(F.size("x"))).first()
        share = (ones or 0.0) / n if n else 0.5
        if not n or not 0 < share < 1:
            return NewtonTreesModel([], math.copysign(700.0, share - 0.5) if n else 0.0, self.rate, size or 0)
        prior = math.log(share / (1 - share))
        rows = rows.withColumn("margin", F.lit(prior)).withColumn("features", array_to_vector("x"))
        trees, losses = [], []
        for k in range(self.rounds):
            tree = self._tree(rows.where(~F.col("held")), k)
            trees.append(tree)
            rows = tree.transform(rows).withColumn("margin", F.col("margin") + self.rate * F.col("step")).drop("step")
            if (k + 1) % WRITTEN == 0:
                rows = materialise(rows.drop("features"), "boosting").withColumn("features", array_to_vector("x"))
            if checked:
                signed = F.when(F.col("label") > 0.5, -F.col("margin")).otherwise(F.col("margin"))
                loss = F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
                losses.append(rows.where("held").agg(F.avg(loss)).first()[0])
                best = losses.index(min(losses))
                if k - best >= self.patience:
                    break
        return NewtonTreesModel(trees[: losses.index(min(losses)) + 1] if losses else trees, prior, self.rate, size)

    def _tree(self, rows: DataFrame, k: int):
        p = _chance(F.col("margin"))
        h = F.greatest(p * (1 - p), F.lit(1e-9))
        rows = rows.withColumn("g", p - F.col("label")).withColumn("weight", h).withColumn("target", -F.col("g") / F.col("weight"))
        if self.top < 1:
            size = F.abs("g")
            least = rows.select(size.alias("g")).approxQuantile("g", [1 - self.top], 0.001)[0]
            drawn = self.other / (1 - self.top)
            # The rows come from a written table, so a repeated task draws the same ones.
            rows = rows.withColumn("draw", F.rand(self.seed + k)).where((size >= least) | (F.col("draw") < drawn))
            rows = rows.withColumn("weight", F.when(size >= least, F.col("weight")).otherwise(F.col("weight") / drawn))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="weight", predictionCol="step", maxDepth=self.depth, seed=self.seed + k)
        return tree.fit(rows.select("features", "target", "weight"))


class NewtonTreesModel(Model):
    """Adds ``probability`` (of 0 and of 1) to rows with ``features``."""

    def __init__(self, trees, prior: float, rate: float, size: int):
        super().__init__()
        self.trees, self.prior, self.rate, self.size = trees, prior, rate, size

    @property
    def featureImportances(self):
        """The trees' mean importances."""
        if not self.trees:
            return DenseVector([0.0] * self.size)
        return DenseVector(sum(t.featureImportances.toArray() for t in self.trees) / len(self.trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        margin, names = F.lit(self.prior), []
        for k, tree in enumerate(self.trees):
            names.append(f"_step{k}")
            df = tree.setPredictionCol(names[-1]).transform(df)
            margin = margin + self.rate * F.col(names[-1])
        p = _chance(margin)
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop(*names)
