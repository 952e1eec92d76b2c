"""Toxicity by maximum-scoring segments of token log-odds.

Fitting: token counts of toxic and other documents (a bounded sample of the
labelled ones) give log-odds with an informative Dirichlet prior.  A word
that the sample has seldom seen takes the log-odds of its leading letters,
of the longest stem that has any.
Tokens whose odds are not significant score zero, and every token pays a
drift, so that the expected score of clean text is negative.

Scoring: one linear scan finds all maximal scoring segments of a text.  The
Karlin-Altschul parameters of the clean token scores turn a segment's score
into a significance; the chance of the sum of the highest segments' normalised
scores is mapped to a probability by a logistic curve fitted on the same
sample.  lambda is exact for independent tokens; K is the bound by single
tokens, which is no less than the true one, so passages are never called
more significant than they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import as_text
from riskloom.llm.common import crc_mod, table
from riskloom.llm.labels import FIT_DOCUMENTS, fit_sample

STEMS = (6, 5, 4)
PRIOR = 300.0
PRIOR_SHARE = 0.1
MIN_Z = 3.0
MIN_TOXIC_DOCUMENTS = 3
DRIFT = 1.0
SIGNIFICANT = 0.01
REMEMBERED = 400_000
ROWS_AT_ONCE = 512
EVIDENCE = 50.0
RIDGE = 1e-3
THRESHOLD = 0.7

_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits, in lower case; bytes over 127 count as letters."""
    return as_text(text).lower().encode().translate(_SEPARATORS).split()


def stems_of(word: bytes) -> list[bytes]:
    """The leading letters, long to short, as tokens of their own (no word contains a space)."""
    text = word.decode("utf-8", "replace")
    return [text[:n].encode() + b" " for n in STEMS if len(text) > n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per token: documents with it, by label; the empty token counts the documents."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(words_of(text))
            counts[label].update(words.union(*map(stems_of, words)) | {b""})
    tokens = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(tokens), 50_000):
        some = tokens[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.binary()), *(pa.array([counts[k][t] for t in some], pa.int64()) for k in (1, 0))], names=["token", "toxic", "clean"]
        )


class Odds(dict):
    """Score of each word; unknown words are worked out once and remembered."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        known = (self.weights.get(t) for t in (word, *stems_of(word)))
        self[word] = score = next((w for w in known if w is not None), 0.0) - DRIFT
        return score


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: a new
    segment joins an earlier one while that raises the score of both."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before and after, the nearest one with a lower sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, i + 1, low, total, j))
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high, _ in out]


class ToxicityModel:
    """Token weights and the calibration; built on the driver, sent to the tasks."""

    def __init__(self, weights: dict[bytes, float], lam: float, k: float, slope: float = 0.0, level: float = 0.0):
        self.weights, self.lam, self.k, self.slope, self.level = weights, lam, k, slope, level
        self._odds = Odds(weights)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.lam, self.k, self.slope, self.level)

    def passages(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal segments in words."""
        words = words_of(text)
        scores = list(map(self._odds.__getitem__, words))
        return len(words), segments(scores) if scores and max(scores) > 0 else []

    def significance(self, score: float, n: int) -> float:
        """Chance that clean text of ``n`` words has a segment of this score."""
        return float(-np.expm1(-self.k * max(n, 1) * np.exp(-self.lam * score)))

    def extreme(self, n: int, scores: list[float]) -> float:
        """Minus the log of the chance that clean text of ``n`` words has so high a
        sum of its r highest segments, for the r that makes it least likely.

        In extreme-value units the sum t of r scores is reached by a chance of
        exp(-t) t^(r-1) / (r! (r-1)!), which holds for t >= r; smaller sums say
        nothing.  Beyond ``EVIDENCE`` no chance is told from another, so a text
        that repeats one weighted word for ever counts as one sure case.
        """
        if not len(scores):
            return 0.0
        over = self.lam * np.sort(scores)[::-1] - np.log(max(1.0, self.k * max(n, 1)))
        total, r = np.cumsum(over), np.arange(1, len(over) + 1)
        log_factorial = np.cumsum(np.log(r))
        holds = total >= r
        if not holds.any():
            return float(np.clip(over[0], 0.0, EVIDENCE))
        value = total - (r - 1) * np.log(np.where(holds, total, 1.0)) + 2 * log_factorial - np.log(r)
        return float(np.clip(value[holds].max(), 0.0, EVIDENCE))

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.level + self.slope * x, -30, 30))))

    def judge(self, text: bytes | None) -> tuple[float, list[tuple[int, int, float]]]:
        n, found = self.passages(text)
        kept = [x for x in found if self.significance(x[2], n) <= SIGNIFICANT]
        return self.probability(self.extreme(n, [x[2] for x in found])), kept


def _karlin(values: np.ndarray, chances: np.ndarray) -> tuple[float, float]:
    """The positive root of E exp(lam s) = 1, and an upper bound of K from the tail of single tokens."""
    if values.max() <= 0:
        return 1.0, 1.0
    low, high = 0.0, 1.0
    while (chances * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (chances * np.exp(mid * values)).sum() < 1 else (low, mid)
    lam = max(low, 1e-3)
    return lam, float((chances * np.where(values > 0, np.exp(np.minimum(lam * values, 50)), 0)).sum())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the least penalised loss: Newton steps, halved until
    the loss falls (plain ones run away where the labels are nearly separable).
    A weak ridge and half a case of each label keep it finite."""
    x, y, w = np.append(x, [0.0, EVIDENCE]), np.append(y, [0.0, 1.0]), np.append(np.ones(len(x)), [0.5, 0.5])
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * beta @ beta)

    beta = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (w * (y - p)) - RIDGE * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(2)
        step, before = np.linalg.solve(hessian, gradient), loss(beta)
        while loss(beta + step) > before and abs(step).max() > 1e-9:
            step = step / 2
        if abs(step).max() <= 1e-9:
            break
        beta = beta + step
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(sample: DataFrame) -> ToxicityModel:
    """Fit on (text, label) rows, which must be bounded; without toxic rows every score is low."""
    counts = (
        sample.mapInArrow(_count, "token binary, toxic long, clean long")
        .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    n = counts.where(F.length("token") == 0).first()
    toxic, clean = (n["toxic"], n["clean"]) if n else (0, 0)
    weights: dict[bytes, float] = {}
    if toxic and clean:
        strength = min(PRIOR, PRIOR_SHARE * (toxic + clean))
        for row in counts.where((F.col("toxic") >= MIN_TOXIC_DOCUMENTS) & (F.length("token") > 0)).toLocalIterator():
            share = (row["toxic"] + row["clean"]) / (toxic + clean)
            prior = max(strength * share, 0.01)
            a, b = row["toxic"] + prior, row["clean"] + prior
            odds = np.log(a / max(toxic + strength - a, 0.5)) - np.log(b / max(clean + strength - b, 0.5))
            z = odds / np.sqrt(1 / a + 1 / b)
            if z >= MIN_Z and odds > DRIFT:
                weights[bytes(row["token"])] = float(odds)
    bare = ToxicityModel(weights, 1.0, 1.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Odds(bare.weights)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                scores = list(map(odds.__getitem__, words))
                distinct = set(words)
                hits = [odds[w] for w in distinct if odds[w] > -DRIFT]
                found = [s for _, _, s in segments(scores)] if hits and max(hits) > 0 else []
                out.append((len(scores), len(distinct), found, hits))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)), batch.column(1)], names=["n", "distinct", "found", "hits", "label"])

    seen = sample.mapInArrow(scan, "n long, distinct long, found array<double>, hits array<double>, label int").toPandas()
    if not len(seen) or not weights:
        rate = (toxic + 0.5) / (toxic + clean + 1) if n else 0.1
        return ToxicityModel(weights, 1.0, 1.0, 0.0, float(np.log(rate / (1 - rate))) if weights or n else -2.0)
    # A word counts once in a text, so that one text that repeats it does not make it common.
    hits = Counter(h for row in seen["hits"][seen["label"] == 0] for h in row)
    words = max(int(seen["distinct"][seen["label"] == 0].sum()), 1)
    for w in weights.values():  # every weight may come by chance, however seldom
        hits[w - DRIFT] += 0.5 / len(weights)
    values = np.array([-DRIFT, *hits])
    chances = np.array([words, *hits.values()]) / (words + sum(hits.values()))
    model = ToxicityModel(weights, *_karlin(values, chances))
    x = np.array([model.extreme(a, b) for a, b in zip(seen["n"], seen["found"], strict=True)])
    model.slope, model.level = _logistic(x, seen["label"].to_numpy(float))
    return model


def judged(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and passages, the significant
    segments (start and end in words, score).

    A null or empty text has no passage and the score of a text without hits;
    null ids and repeated rows stay; other columns are ignored; no rows give
    no rows.  A narrow map.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value.judge
        for batch in batches:
            found = list(map(judge, batch.column(1).to_pylist()))
            kept = [[{"start": a, "end": b, "score": s} for a, b, s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.float64()), pa.array(kept, passage)], names=["doc_id", "score", "passages"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,score:double>>")


def fit_tables(spark, sf_dir: str, docs: DataFrame | None = None, size: int = FIT_DOCUMENTS) -> ToxicityModel:
    """The model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(fit_sample(docs, table(spark, sf_dir, "labels"), "toxic", crc_mod(F.col("doc_id"), 3) != 1, size))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = judged(table(spark, sf_dir, "documents"), fit_tables(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def keep_rows(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows whose texts ``keep()`` accepts, with all their columns; a narrow map.

    ``keep()`` gives a function from the texts (bytes or None) of some rows,
    ``ROWS_AT_ONCE`` at most, to one truth value each.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts = rows.column(place).cast(pa.binary()).to_pylist()
                yield rows.filter(pa.array(test(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, fitted on the labels of ``docs``, predicts as toxic.

    Every row is judged by its own text, null or empty as a text without hits,
    whatever its id; repeated rows stay or go together; all columns are kept;
    no rows give no rows.
    """
    sent = spark.sparkContext.broadcast(fit_tables(spark, sf_dir, docs))

    def keep():
        judge = sent.value.judge
        return lambda texts: [judge(text)[0] < THRESHOLD for text in texts]

    return keep_rows(docs, keep)
