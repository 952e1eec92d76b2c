"""Walks made whole in one task against those made step by step."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.operators import graph, walker


def test_hashes_are_those_of_spark(spark):
    rows = [(i * 7919 - 2**40 * (i % 3), i - 50) for i in range(100)] + [(-(2**63), -(2**31)), (2**63 - 1, 2**31 - 1)]
    got = spark.createDataFrame(rows, "a long, b int").coalesce(1).select(F.xxhash64("a", "b")).collect()
    made = walker.hash_int(np.array([b for _, b in rows], np.int32), walker.hash_long(np.array([a for a, _ in rows]), walker.START))
    assert [r[0] for r in got] == made.view(np.int64).tolist()
    assert walker.hash_int(7, walker.START)[0] == xxhash.xxh64_intdigest((7).to_bytes(4, "little"), seed=42)


@pytest.mark.parametrize("restart", [0.0, 0.3])
def test_whole_walks_are_those_of_steps(spark, monkeypatch, restart):
    """Hubs with several pieces, nodes without edges, repeated edges, negative ids, several files."""
    monkeypatch.setattr(graph, "PIECE", 4)
    edges = [(0, -i, 1.0) for i in range(1, 40)] + [(-i, 0, 1.0) for i in range(1, 20)] + [(50, 2**40, 1.0), (50, 50, 1.0)] + [(-3, j, 1.0) for j in range(100, 107)] * 2 + [(100, -3, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    whole = sorted(map(tuple, graph.random_walks(df, 9, 11, restart=restart).collect()))
    monkeypatch.setattr(graph, "HELD", 0)
    assert whole == sorted(map(tuple, graph.random_walks(df, 9, 11, restart=restart).collect())) and len(whole) == 9 * len({n for e in edges for n in e[:2]})
    assert len({len(nodes) for *_, nodes in whole}) > 2


def test_no_edges_and_one_step(spark):
    df = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    assert graph.random_walks(df.limit(0), 3, 5).count() == 0
    assert sorted(r["nodes"] for r in graph.random_walks(df, 1, 1).collect()) == [[1], [2]]


def test_walks_leave_only_links_on_disk(spark):
    """Of 200,000 nodes of walks nothing is written."""
    edges = spark.range(50).selectExpr("id AS src", "(id + 1) % 50 AS dst", "1.0D AS weight")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in Path(os.path.normpath(folder)).rglob("*.parquet"))
    before = size()
    walks = graph.random_walks(edges, 80, 50)
    assert walks.selectExpr("sum(size(nodes))").first()[0] == 200_000 and size() - before < 40_000


def test_vectors_of_several_tasks_tell_cliques_apart(spark, monkeypatch):
    """One task for each 1,000 nodes of walks, four cores: every task's vectors count."""
    from pyspark.ml.feature import Word2Vec

    made, fit = [], Word2Vec._fit
    monkeypatch.setattr(Word2Vec, "_fit", lambda self, rows: made.append(self.getNumPartitions()) or fit(self, rows))
    monkeypatch.setattr(graph, "LEARNT", 1000)
    pairs = [(a, b, 1.0) for k in (0, 100) for a in range(k, k + 8) for b in range(k, k + 8) if a != b]
    walks = graph.random_walks(spark.createDataFrame(pairs, "src long, dst long, weight double"), 40, 10)
    vectors = {int(r["node"]): np.array(r["vector"]) for r in graph.walk_embeddings(walks, 8, 3, iterations=12).collect()}
    unit = {n: v / np.linalg.norm(v) for n, v in vectors.items()}
    assert made == [4] and len(unit) == 16
    near = np.mean([unit[a] @ unit[b] for a, b, _ in pairs])
    assert near > np.mean([unit[a] @ unit[b + 100] for a in range(8) for b in range(8)]) + 0.3
