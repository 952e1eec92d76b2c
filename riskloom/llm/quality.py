"""Quality by histogram gradient-boosted trees over document statistics.

Statistics come from one narrow pass over the texts.  The trees are grown on
the driver from a bounded sample, on features binned by quantiles, and kept
as flat arrays (feature, bin, child, value); a batch of documents walks all
trees at once in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import as_text
from riskloom.llm.common import crc_mod, table
from riskloom.llm.labels import FIT_DOCUMENTS, fit_sample
from riskloom.llm.toxicity import keep_rows

TREES = 60
LEVELS = 4
BINS = 64
RATE = 0.15
RIDGE = 1.0
MIN_WEIGHT = 5.0
THRESHOLD = 0.7

_CLASSES = bytes(
    1 if chr(c).isspace() else 2 if 48 <= c < 58 else 3 if 65 <= c < 91 else 4 if 97 <= c < 123 else 5 if c >= 128 else 6 if chr(c) in ".,;:'\"-?()" else 7 if c > 32 else 8
    for c in range(256)
)
_SENTENCE_END = re.compile(rb"[.?!]\s")
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "repeated_neighbours", "short_words",
    "spaces", "digits", "capitals", "not_ascii", "punctuation", "symbols", "controls", "log_lines", "distinct_lines", "line_length",
    "words_without_letters", "words_ending_in_symbols", "sentence_ends", "longest_word", "upper_words",
)


def statistics(text: bytes | None) -> tuple[float, ...]:
    """``STATISTICS`` of one text; ratios of an empty text are zero."""
    data = (text or b"").strip()
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    seen = Counter(words)
    classes = Counter(data.translate(_CLASSES))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shape = data.translate(_CLASSES).split(b"\x01")
    return (
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n, len(seen) / n, max(seen.values(), default=0) / n,
        len(set(pairwise(words))) / n, sum(a == b for a, b in pairwise(words)) / n, sum(len(w) < 4 for w in words) / n,
        classes[1] / size, classes[2] / size, classes[3] / size, classes[5] / size, classes[6] / size, classes[7] / size, classes[8] / size,
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), np.log1p(size / max(len(lines), 1)),
        sum(not w.strip(b"\x02\x06\x07\x08") for w in shape if w) / n, sum(w.endswith(b"\x07") for w in shape) / n, len(_SENTENCE_END.findall(data)) / n,
        np.log1p(max(map(len, words), default=0)), sum(w.isupper() for w in words) / n,
    )


def statistics_of(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    return np.array(list(map(statistics, texts)), float).reshape(-1, len(STATISTICS))


class BoostedTrees:
    """Flat arrays of complete binary trees: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, edges: list[np.ndarray], start: float):
        self.edges, self.start = edges, start
        self.feature = np.zeros((0, 2**LEVELS - 1), np.int32)
        self.bin = np.zeros((0, 2**LEVELS - 1), np.int32)
        self.value = np.zeros((0, 2**LEVELS))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """All trees advance one level at a time; a leaf's place is its node minus the inner nodes."""
        rows, trees = np.arange(len(bins))[:, None], np.arange(len(self.value))
        node = np.zeros((len(bins), len(trees)), np.int64)
        for _ in range(LEVELS):
            node = 2 * node + 1 + (bins[rows, self.feature[trees, node]] > self.bin[trees, node])
        return self.start + self.value[trees, node - (2**LEVELS - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(self.binned(x)), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Boosting with logistic loss and second-order leaf values; deterministic.

    Without rows, or with one label only, the score is the smoothed share of
    label 1 for all texts.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(STATISTICS)
    model = BoostedTrees(edges, float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    bins = model.binned(x)
    features = bins.shape[1]
    place = bins + np.arange(features) * BINS
    score = np.full(len(y), model.start)
    chosen, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = p - y, p * (1 - p)
        feature, cut = np.zeros(2**LEVELS - 1, np.int32), np.full(2**LEVELS - 1, BINS, np.int32)
        node = np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (features * BINS) + place).ravel()
            g, h = (np.bincount(cell, np.repeat(w, features), width * features * BINS).reshape(width, features, BINS).cumsum(2) for w in (gradient, weight))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < MIN_WEIGHT) | (h_all - h < MIN_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(useful, best // BINS, 0)
            cut[first : first + width] = np.where(useful, best % BINS, BINS)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**LEVELS - 1)
        g, h = (np.bincount(leaf, w, 2**LEVELS) for w in (gradient, weight))
        value = -RATE * g / (h + RIDGE)
        score += value[leaf]
        chosen.append(feature), cuts.append(cut), values.append(value)
    model.feature, model.bin, model.value = np.array(chosen), np.array(cuts), np.array(values)
    return model


def fit(sample: DataFrame) -> BoostedTrees:
    """Fit on (text, label) rows, which must be bounded; their statistics go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(map(statistics, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(map(list, rows), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    seen = sample.mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort([*x.T, seen["label"].to_numpy(int)])
    return grow(x[order], seen["label"].to_numpy(float)[order])


def scored(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and score (0 to 1).

    A null text counts as empty and is scored like any other; null ids and
    repeated rows stay; other columns are ignored; no rows give no rows.  A
    narrow map.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.probability(statistics_of(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def fit_tables(spark, sf_dir: str, docs: DataFrame | None = None, size: int = FIT_DOCUMENTS) -> BoostedTrees:
    """The model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(fit_sample(docs, table(spark, sf_dir, "labels"), "quality", crc_mod(F.col("doc_id"), 4) != 2, size))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), fit_tables(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, fitted on the labels of ``docs``, predicts as poor.

    Every row is judged by its own text, null as an empty one, whatever its
    id, and a batch walks all trees at once; repeated rows stay or go
    together; all columns are kept; no rows give no rows.
    """
    sent = spark.sparkContext.broadcast(fit_tables(spark, sf_dir, docs))

    def keep():
        model = sent.value
        return lambda texts: model.probability(statistics_of(texts)) >= THRESHOLD

    return keep_rows(docs, keep)
