from __future__ import annotations

import numpy as np
import pytest

from riskloom.llm.ann import group_buckets, group_ranges, nearest, op10_nearest


def brute(ids, vectors, asked, k=20):
    scores = vectors @ vectors.T
    out = {}
    for q in np.flatnonzero(asked):
        rest = [i for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = [int(ids[i]) for i in sorted(rest, key=lambda i: (-scores[q, i], ids[i]))[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query_recall_and_scores(spark, sf, scale):
    sf = sf.replace("sf0.001", scale)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = by_query(op10_nearest(spark, sf).collect())
    want = brute(ids, vectors, ids % 20 == 0)
    assert set(got) == set(want)
    place = {int(i): n for n, i in enumerate(ids)}
    found = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert found / sum(map(len, want.values())) >= 0.9
    for q, own in got.items():
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q for r in own)
        for r in own:
            assert r["score"] == pytest.approx(float(vectors[place[q]] @ vectors[place[r["vec_id"]]]), abs=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (8, [None, 1.0]), (9, []), (10, [-1.0, 0.0]), (None, [1.0, 0.0]), (20, [2.0, 0.0]), (40, None), (11, [1.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = by_query(nearest(df, lambda c: c % 20 == 0, k=4).collect())
    assert {q: [r["vec_id"] for r in x] for q, x in got.items()} == {0: [20, 1, 2, 3], 20: [0, 1, 2, 3]}
    few = by_query(nearest(df.where("vec_id in (0, 1, 10)"), lambda c: c % 20 == 0).collect())
    assert {q: [r["vec_id"] for r in x] for q, x in few.items()} == {0: [1, 10]}
    assert nearest(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_one_hot_bucket(spark):
    """A third of all rows are one vector; ties still go to the smaller ids."""
    random = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else random.normal(size=3).tolist()) for i in range(900)]
    got = by_query(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0, k=5).collect())
    ids, vectors = np.arange(900), np.array([v for _, v in rows])
    want = brute(ids, vectors, ids % 60 == 0, 5)
    assert all([r["vec_id"] for r in got[q]] == want[q] for q in want if (vectors[q] == [1, 2, 0]).all() and np.allclose((vectors[want[q]] - vectors[q]), 0))
    assert len(got) == 45


def test_other_queries_beside_a_hot_vector(spark):
    """A group of equal vectors does not shorten the search of the other queries."""
    random = np.random.default_rng(2)
    rows = [(i, np.eye(24)[0].tolist() if i % 3 == 0 else random.normal(size=24).tolist()) for i in range(3000)]
    got = by_query(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0).collect())
    ids, vectors = np.arange(3000), np.array([v for _, v in rows])
    want = {q: w for q, w in brute(ids, vectors, ids % 20 == 0).items() if q % 3}
    found = sum(len({r["vec_id"] for r in got[q]} & set(w)) for q, w in want.items())
    assert found / sum(map(len, want.values())) >= 0.9


def test_lengths_and_repeated_ids(spark):
    """One longer row hides no others; every vector of an id takes part."""
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.0]), (2, [-1.0, 0.0]), (2, [0.95, 0.0]), (3, [0.1, 0.2]), (20, [1.0, 0.0, 0.0]), (21, [0.5, 0.5, 0.0]), (4, [1.0, 2.0, 3.0, 4.0])]
    got = by_query(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0, k=3).collect())
    assert {q: [(r["vec_id"], r["score"]) for r in x] for q, x in got.items()} == {0: [(2, 0.95), (1, 0.9), (3, 0.1)], 20: [(21, 0.5)]}


def test_an_id_with_many_vectors_takes_one_rank(spark):
    rows = [(0, [1.0, 0.0]), *((7, [1.0 - i / 1000, 0.1]) for i in range(50)), (8, [0.5, 0.0]), (9, [0.4, 0.0])]
    got = by_query(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0, k=3).collect())
    assert {q: [r["vec_id"] for r in x] for q, x in got.items()} == {0: [7, 8, 9]}


def test_groups_hold_their_buckets():
    sizes = np.array([0, 5, 3000, 10, 0, 700, 700, 900])
    first, parts = group_buckets(sizes, 4, 1000)
    low, high = group_ranges(first, parts)
    held = np.zeros(len(low))
    for place, size in enumerate(sizes):
        for g in range(first[place], first[place] + parts[place]):
            assert low[g] <= place < high[g]
            held[g] += size / parts[place]
    assert held.max() <= 1000 and all(a // 4 == (b - 1) // 4 for a, b in zip(low, high, strict=True))


def test_many_slices_of_queries(spark, monkeypatch):
    """Any sizes of groups and slices give the same neighbours."""
    from riskloom.llm import ann

    random = np.random.default_rng(4)
    df = spark.createDataFrame([(i, random.normal(size=4).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, nearest(df, lambda c: c % 5 == 0, k=7).collect()))
    monkeypatch.setattr(ann, "GROUP_ROWS", (20, 40))
    monkeypatch.setattr(ann, "SLICE_QUERIES", (9, 12))
    assert sorted(map(tuple, nearest(df, lambda c: c % 5 == 0, k=7).collect())) == want
