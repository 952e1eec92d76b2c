from __future__ import annotations

import math
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.common import crc_mod
from riskloom.llm.lm_scoring import DEPTH, END, log_kt, op1_lm_scoring, score_corpus, tokenize


def tree_scores(texts, learn):
    """A plain context tree with one dictionary per node, for small texts."""
    counts = {}

    def stream(text):
        words = tokenize(text)
        data = b"".join(w + b" " for w in words) + END
        past = bytes(DEPTH - 1) + b" " + data
        return [(past[i : i + DEPTH][::-1], data[i]) for i in range(len(data))]

    def decisions(byte):
        return [((1 << k) + (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    for text, use in zip(texts, learn, strict=True):
        for context, byte in stream(text):
            for node, bit in decisions(byte):
                for d in range(DEPTH + 1):
                    counts.setdefault((context[:d], node), [0, 0])[bit] += use
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    weighted = {}

    def log_weighted(key):
        if key not in weighted:
            kt = float(log_kt(np.array([counts[key][0]]), np.array([counts[key][1]]))[0])
            below = sum(map(log_weighted, children.get(key, ())))
            weighted[key] = kt if len(key[0]) == DEPTH else np.logaddexp(kt, below) - math.log(2)
        return weighted[key]

    def probability(context, node, bit):
        p = None
        for d in range(DEPTH, -1, -1):
            key = (context[:d], node)
            a, b = counts[key]
            kt = ((a, b)[bit] + 0.5) / (a + b + 1)
            if p is None:
                p = kt
            else:
                own_log = float(log_kt(np.array([a]), np.array([b]))[0])
                own = 1 / (1 + math.exp(sum(map(log_weighted, children[key])) - own_log))
                p = own * kt + (1 - own) * p
        return p

    return [sum(math.log10(probability(c, n, bit)) for c, byte in stream(t) for n, bit in decisions(byte)) for t in texts]


def test_scores_of_a_plain_context_tree(spark):
    texts = [b"the cat sat", b"the cat sat on a mat", b"a b a", b"", b"dogs sat on the mat of the cat", b"of it is a on"]
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_corpus(docs, F.col("doc_id") == 4).collect()}
    want = tree_scores(texts, [i != 4 for i in range(len(texts))])
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(want[i], rel=1e-6)
        assert got[i]["n_bytes"] == sum(len(w) + 1 for w in tokenize(t)) + 1


def test_counts_and_base(spark, sf):
    got = op1_lm_scoring(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, t in docs.items() if not held[i] for w in [*tokenize(t.encode()), END])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for r in got:
        words = [*tokenize(docs[r["doc_id"]].encode()), END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(counts[w] > 0 for w in words), n, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))


def test_better_than_single_words_on_unseen_texts(spark, sf):
    unseen = op1_lm_scoring(spark, sf.replace("sf0.001", "sf0.1")).where("held_out").collect()
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = score_corpus(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()
    assert len(rows) == len(cases.TEXTS) and sum(r["doc_id"] is None for r in rows) == 2
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[1]["score"] == by[2]["score"] < 0
    assert by[6]["score"] == by[7]["score"]
    assert score_corpus(cases.empty(spark), F.lit(False)).count() == 0


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    r = score_corpus(docs, F.lit(True)).first()
    assert r["score"] == pytest.approx(-3 * 8 * math.log10(2)) and r["n_known"] == 0 and r["base_score"] == 0
