"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.storage import materialise

FIT_DOCUMENTS = 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, size: int = FIT_DOCUMENTS) -> DataFrame:
    """(text, label) of at most ``size`` labelled documents, the same ones each time.

    ``learn`` is a condition on ``doc_id``.  The ids are chosen by hash from the
    labels alone; with at most ``size`` rows they are broadcast, so no text is
    shuffled, and the sample is written, so the texts are read once.  Null labels or ids do not take part; of repeated labels the
    largest counts.
    """
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return materialise(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"), "fit-sample")
