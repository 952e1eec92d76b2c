"""Toxicity and quality: the scan and the trees by brute force, the models by held-out accuracy."""

from __future__ import annotations

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import quality, toxicity
from riskloom.llm.labels import fit_sample


def maximal_segments(scores):
    """By definition: the best segment, then the best ones left and right of it."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best or at and total == best and j - i < at[1] - at[0] - 1:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    left, right = maximal_segments(scores[:a]), maximal_segments(scores[b:])
    return [*left, (a, b, best), *((x + b, y + b, s) for x, y, s in right)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_all_maximal_segments(scores):
    # distinct sums, so that there are no ties between segments
    scores = [s + (i + 1) / 1024 * (1 if i % 2 else -1) * 0.37 ** (i % 5) for i, s in enumerate(scores)]
    got = toxicity.segments(scores)
    assert [x[:2] for x in got] == [x[:2] for x in maximal_segments(scores)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in maximal_segments(scores)])


def held_out(spark, sf, query, target):
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", F.col(target).alias("y")).collect()
    assert len(rows) > 50
    return np.array([r["predicted"] for r in rows]), np.array([r["y"] for r in rows])


def test_held_out_recall(spark, sf):
    """Of either label: a model that never says "toxic" is right on nine in ten.
    Some toxic texts hold words that no text of so small a sample has."""
    sf = sf.replace("sf0.001", "sf0.1")
    for query, target, least in ((toxicity.op6_toxicity, "toxic", 0.85), (quality.op7_quality, "quality", 0.95)):
        predicted, y = held_out(spark, sf, query, target)
        assert (predicted[y == 1] == 1).mean() > least
        assert (predicted[y == 0] == 0).mean() > 0.95


def test_calibration_does_not_run_away():
    """Nearly separable scores with a heavy tail: the curve is that of a plain
    descent, and toxic texts are told apart in every sample."""
    random = np.random.default_rng(3)
    for trial in range(40):
        n = int(random.integers(300, 6000))
        y = (random.random(n) < 0.12).astype(float)
        x = np.where(y == 1, np.minimum(random.lognormal(3.2, 0.9, n) + 12, toxicity.EVIDENCE), np.maximum(random.normal(-3, 3, n), 0))
        x, y = np.append(x, [toxicity.EVIDENCE] * (trial % 3)), np.append(y, [0.0] * (trial % 3))
        slope, level = toxicity._logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(level + slope * x, -500, 500)))
        assert (p[y == 1] >= toxicity.THRESHOLD).mean() > 0.9 and (p[:n][y[:n] == 0] >= toxicity.THRESHOLD).mean() < 0.01
        gradient = np.array([x @ (y - p), (y - p).sum()])
        assert abs(gradient).max() < 40  # the ridge and half a case at either end are all that pulls elsewhere


def test_long_clean_text_with_repeats_is_no_toxic_text_and_spoils_no_fit(spark):
    random = np.random.default_rng(1)
    plain, vile = [f"plain{i}" for i in range(300)], [f"vile{i}" for i in range(12)]

    def text(n, bad):
        words = list(random.choice(plain, n))
        for _ in range(bad):
            words.insert(int(random.integers(len(words))), str(random.choice(vile)))
        return " ".join(words).encode()

    rows = [(text(60, 0), 0) for _ in range(300)] + [(text(60, 12), 1) for _ in range(60)]
    rows += [((b"vile0 " * 3000 + text(20_000, 0)), 0), (text(20_000, 0), 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "text binary, label int"))
    toxic, clean = [text(60, 12) for _ in range(100)], [text(60, 0) for _ in range(100)]
    assert np.mean([model.judge(t)[0] >= toxicity.THRESHOLD for t in toxic]) > 0.9
    assert np.mean([model.judge(t)[0] >= toxicity.THRESHOLD for t in clean]) < 0.05


def test_sum_statistic():
    """The chance of one segment is exp(-x); weak segments add nothing, strong ones more than their sum's own formula."""
    model = toxicity.ToxicityModel({}, 1.0, 1.0)
    assert model.extreme(1, []) == 0.0 and model.extreme(1, [-2.0]) == 0.0
    assert model.extreme(1, [7.0]) == pytest.approx(7.0)
    assert model.extreme(1, [7.0, 0.1]) == pytest.approx(7.0)
    assert model.extreme(1, [7.0, 6.0]) == pytest.approx(13 - np.log(13) + np.log(2))
    assert model.extreme(20_000, [3.0] * 600) == 0.0  # ln 20,000 is 9.9
    assert model.extreme(1, [9.0] * 600) == toxicity.EVIDENCE


def test_passages(spark):
    rows = [(f"nice words here and there number{i}", 0) for i in range(40)] + [(f"nice words you vile scum here and there w{i}", 1) for i in range(20)]
    model = toxicity.fit(spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, label int"))
    clean, toxic = ("nice words here and there " * 4).strip(), "nice words here and there vile scum here and there"
    low, none = model.judge(clean.encode())
    high, found = model.judge(toxic.encode())
    assert low < 0.5 < 0.7 < high and none == [] and [x[:2] for x in found] == [(5, 7)]
    assert model.judge(None)[0] == model.judge(b"")[0] < 0.5


def test_trees_walk_like_a_loop():
    random = np.random.default_rng(5)
    x = random.normal(size=(600, len(quality.STATISTICS)))
    y = (x[:, 3] + x[:, 7] * (x[:, 1] > 0) > 0).astype(float)
    model = quality.grow(x, y)
    bins = model.binned(x[:50])
    for row, got in zip(bins, model.raw(bins), strict=True):
        total = model.start
        for f, c, v in zip(model.feature, model.bin, model.value, strict=True):
            node = 0
            for _ in range(quality.LEVELS):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - (2**quality.LEVELS - 1)]
        assert got == pytest.approx(total)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("rows", [[], [(b"a", 1)], [(b"a b", 0), (None, 0)]])
def test_one_label_or_none(spark, rows):
    sample = spark.createDataFrame(rows, "text binary, label int")
    for fitted in (toxicity.fit(sample), quality.fit(sample)):
        assert fitted is not None
    docs = cases.documents(spark)
    assert toxicity.judged(docs, toxicity.fit(sample)).count() == quality.scored(docs, quality.fit(sample)).count() == len(cases.TEXTS)


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    marks = cases.labels(spark, [(i, i % 2, 1 - i % 2, "t", "l") for i in (1, 2, 4, 5, 6, 6, 8, 9)] + [(None, 1, 1, "t", "l"), (10, None, None, "t", "l")])
    sample = fit_sample(docs, marks, "toxic", F.lit(True))
    assert sorted(r["label"] for r in sample.collect()) == [0, 0, 0, 1, 1, 1, 1, 1]  # rows 1, 5, 9; and 2, 4, 6 twice, 8
    assert fit_sample(docs, marks, "toxic", F.lit(True), size=2).count() <= 4
    for module, model in ((toxicity, toxicity.fit(sample)), (quality, quality.fit(sample))):
        out = (toxicity.judged if module is toxicity else quality.scored)(docs, model).collect()
        assert len(out) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.judged(cases.empty(spark), toxicity.fit(sample)).count() == quality.scored(cases.empty(spark), quality.fit(sample)).count() == 0
    kept = toxicity.keep_rows(docs, lambda: lambda texts: [t is None or len(t) > 3 for t in texts])
    assert kept.columns == docs.columns and kept.count() == sum(t is None or len(t.encode()) > 3 for _, t in cases.TEXTS)
