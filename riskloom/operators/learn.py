"""Model building on feature tables with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import with_running
from riskloom.sources.storage import materialise

#: Labels whose first places are sent to all tasks.
MOST_LABELS = 10_000


def with_folds(df: DataFrame, key: str, label: str | None, folds: int, seed: int = 2018, name: str = "fold") -> DataFrame:
    """Fold numbers by hashed order of the key: within each label, so the
    folds hold equal shares; without a label, by the hash alone."""
    mark = F.xxhash64(F.lit(seed), key)
    if label is None:
        return df.withColumn(name, F.pmod(mark, F.lit(folds)).cast("int"))
    # A label's rows follow each other in one global order, so no label is sorted in one task.
    placed = with_running(df.withColumn("_mark", mark), [label, "_mark", key], {"_place": F.lit(1)})
    first = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_place").alias("_first"))
    first = materialise(first, "labels")
    small = F.broadcast(first) if first.count() <= MOST_LABELS else first
    rows = placed.join(small, placed[label].eqNullSafe(F.col("_label")))
    return rows.withColumn(name, F.pmod(F.col("_place") - F.col("_first"), F.lit(folds)).cast("int")).select(*df.columns, name)


def assembled(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="keep").transform(df)


def boosted(seed: int = 2018, rounds: int = 20, depth: int = 4, rate: float = 0.1, subsample: float = 1.0, stop_early: bool = False) -> GBTClassifier:
    """Boosted trees; with ``stop_early`` the rounds end once the loss of the
    rows marked ``held`` (the held-out fold) falls by less than a hundredth."""
    model = GBTClassifier(featuresCol="features", labelCol="label", seed=seed, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample)
    return model.setValidationIndicatorCol("held") if stop_early else model


def forest(seed: int = 2018, trees: int = 20, depth: int = 6, features: str = "sqrt", bootstrap: bool = True) -> RandomForestClassifier:
    """A random forest; without bootstrap, the nearest to extra trees that Spark has."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, numTrees=trees, maxDepth=depth, featureSubsetStrategy=features, bootstrap=bootstrap)


def out_of_fold(df: DataFrame, key: str, columns: Sequence[str], label: str, model: Callable[[], Estimator], folds: int, fold: str = "fold", test: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions (key, label, score) and mean importances
    (feature, importance); with ``test``, its mean predictions join the first."""
    rows = assembled(df.select(key, fold, F.col(label).cast("double").alias("label"), *columns), columns)
    rows = materialise(rows.select(key, fold, "label", vector_to_array("features").alias("x")), "folds").withColumn("features", array_to_vector("x"))
    scored, gains, tests = [], [], []
    for k in range(folds):
        own = model()
        stops = own.hasParam("validationIndicatorCol") and own.isDefined("validationIndicatorCol")
        fitted = own.fit(rows.withColumn("held", F.col(fold) == k) if stops else rows.where(F.col(fold) != k))
        score = vector_to_array("probability")[1].alias("score")
        scored.append(fitted.transform(rows.where(F.col(fold) == k)).select(key, "label", score))
        gains.append(fitted.featureImportances.toArray())
        if test is not None:
            tests.append(fitted.transform(assembled(test.select(key, *columns), columns)).select(key, F.lit(None).cast("double").alias("label"), score))
    out = reduce(DataFrame.unionByName, scored)
    if tests:
        out = out.unionByName(reduce(DataFrame.unionByName, tests).groupBy(key, "label").agg(F.avg("score").alias("score")))
    spark = df.sparkSession
    importance = spark.createDataFrame([(c, float(sum(g[i] for g in gains) / folds)) for i, c in enumerate(columns)], "feature string, importance double")
    return out, importance


def top_features(importance: DataFrame, k: int = 50) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def blended(frames: Mapping[str, tuple[DataFrame, float]], key: str, score: str) -> DataFrame:
    """Weighted sum of the scores of several models, by key."""
    parts = [f.select(key, (F.col(score) * w).alias("_s")) for f, w in frames.values()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("_s").alias(score))


def mean_by_key(frames: Sequence[DataFrame], key: str, score: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (f.select(key, score) for f in frames)).groupBy(key).agg(F.avg(score).alias(score))


def stacked(df: DataFrame, key: str, columns: Sequence[str], label: str, models: Mapping[str, Callable[[], Estimator]], meta: Callable[[], Estimator], folds: int) -> DataFrame:
    """(key, label, score): out-of-fold scores of the base models are the features of a second model, out of fold again."""
    base = df.select(key, label, "fold")
    for name, model in models.items():
        scores, _ = out_of_fold(df, key, columns, label, model, folds)
        base = base.join(scores.select(key, F.col("score").alias(name)), key)
    return out_of_fold(base, key, list(models), label, meta, folds)[0]


def ensemble(df: DataFrame, key: str, columns: Sequence[str], label: str, models: Sequence[Callable[[], Estimator]], folds: int, test: DataFrame | None = None) -> DataFrame:
    """(key, score): the mean of the out-of-fold scores of several parameter sets."""
    return mean_by_key([out_of_fold(df, key, columns, label, m, folds, test=test)[0] for m in models], key, "score")


def save_model(model, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def median_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaNs become the column's median (approximate, one pass)."""
    return Imputer(strategy="median", inputCols=list(columns), outputCols=list(columns), relativeError=0.0001).fit(df).transform(df)


def median(df: DataFrame, column: str) -> DataFrame:
    """One row with the exact median of a column's known values, from running
    counts of its distinct values by ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = materialise(with_running(counts, ["v"], {"upto": F.col("n")}), "median")
    total = upto.agg(F.max("upto").alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    at = [F.min(F.when(F.col("upto") >= place, F.col("v"))) for place in (low, high)]
    return upto.join(F.broadcast(total)).agg(((at[0] + at[1]) / 2).alias(column))


def median_filled_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median."""
    for c in columns:
        df = df.join(F.broadcast(median(df, c).withColumnRenamed(c, "_median"))).withColumn(c, F.coalesce(c, "_median")).drop("_median")
    return df


def information_value(df: DataFrame, column: str, label: str, tie: str, bins: int = 15) -> DataFrame:
    """(bin, goods, bads, woe, iv_part) by equal-count bins, with half a case added to each cell.

    Places come from the distributed running count, not from one sorted task.
    """
    from riskloom.operators.scores import cumulative

    places = cumulative(df.where(F.col(column).isNotNull()).withColumn("_x", -F.col(column)), "_x", label, tie)
    n = places.agg(F.max("place").alias("n"))
    binned = places.join(F.broadcast(n)).withColumn("bin", F.floor((F.col("place") - 1) * bins / F.col("n")).cast("int"))
    cells = binned.groupBy("bin").agg(F.count_if(F.col("label") == 0).alias("goods"), F.count_if(F.col("label") == 1).alias("bads"))
    totals = cells.agg(F.sum("goods").alias("all_goods"), F.sum("bads").alias("all_bads"))
    good, bad = (F.col("goods") + 0.5) / F.col("all_goods"), (F.col("bads") + 0.5) / F.col("all_bads")
    woe = F.log(good / bad)
    return cells.join(F.broadcast(totals)).select("bin", "goods", "bads", woe.alias("woe"), ((good - bad) * woe).alias("iv_part"))


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, components): centred, then projected."""
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    steps = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False), PCA(k=k, inputCol="c", outputCol="p")])
    return steps.fit(rows).transform(rows).select(key, vector_to_array("p").alias("components"))
