"""Queries over whole tables against brute force."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import connect

from riskloom.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def edges(sf):
    """Edges between nations, counted line by line."""
    con = connect(sf)
    customers, suppliers, orders = (dict(con.execute(f"SELECT {c} FROM {t}").fetchall()) for c, t in (("c_custkey, c_nationkey", "customer"), ("s_suppkey, s_nationkey", "supplier"), ("o_orderkey, o_custkey", "orders")))
    lines = con.execute("SELECT l_orderkey, l_suppkey FROM lineitem").fetchall()
    return Counter((customers[orders[o]], suppliers[s]) for o, s in lines if o in orders and orders[o] in customers and s in suppliers)


def rows(spark, sf, name):
    return [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def test_graph_of_all_order_lines(spark, sf, edges):
    both = Counter()
    for (a, b), n in edges.items():
        both[a, b] += n
        both[b, a] += n
    assert {(a, b): w for a, b, w in rows(spark, sf, "undirected_edges")} == both
    targets = {a: sorted({d for s, d in edges if s == a}) for a, _ in edges}
    assert {a: [int(x) for x in t.split()] for a, t in rows(spark, sf, "adjacency_list")} == targets
    assert dict(rows(spark, sf, "node_degree")) == {a: len(t) for a, t in targets.items()}
    inner = {r[0] for r in connect(sf).execute("SELECT n_nationkey FROM nation WHERE n_regionkey = 1").fetchall()}
    assert {(a, b): w for a, b, w in rows(spark, sf, "subgraph_edges")} == {e: n for e, n in edges.items() if set(e) <= inner}
    assert {(a, b): w for a, b, w in rows(spark, sf, "edges_without_loops")} == {e: n for e, n in edges.items() if e[0] != e[1]}
    assert rows(spark, sf, "self_loops") == [(sum(a == b for a, b in edges),)]
    assert rows(spark, sf, "graph_order") == [(len({n for e in edges for n in e}), len({tuple(sorted(e)) for e in edges}))]
    assert {(a, b): p for a, b, p in rows(spark, sf, "edge_lookup")} == {(i, (i + 1) % 25): int((i, (i + 1) % 25) in edges) for i in range(25)}


def chance(seed, walk, step):
    """The hash of (int, long, int) columns, as a share."""
    mark = 42
    for data in (struct.pack("<i", seed), struct.pack("<q", walk), struct.pack("<i", step)):
        mark = xxhash.xxh64_intdigest(data, seed=mark)
    return mark % (1 << 30) / float(1 << 30)


def number(start, n):
    """The number of a walk, the hash of (long, int) columns as a signed long."""
    mark = xxhash.xxh64_intdigest(struct.pack("<i", n), seed=xxhash.xxh64_intdigest(struct.pack("<q", start), seed=42))
    return mark - (1 << 64) if mark >> 63 else mark


def plain_walk(both, start, n, steps, seed=66, restart=0.0, weighted=False):
    nodes, walk = [start], number(start, n)
    for step in range(1, steps):
        targets = sorted(d for s, d in both if s == nodes[-1])
        if not targets:
            break
        upto, total = [], 0.0
        for d in targets:
            total += both[nodes[-1], d] if weighted else 1.0
            upto.append(total)
        x = chance(seed, walk, step) * total
        chosen = targets[min(sum(u <= x for u in upto), len(targets) - 1)]
        nodes.append(start if chance(seed + 1, walk, step) < restart else chosen)
    return nodes


@pytest.mark.parametrize("name, passes, restart", [("random_walks", 3, 0.0), ("weighted_walks", 2, 0.1)])
def test_walks_are_those_of_a_plain_walker(spark, sf, edges, name, passes, restart):
    both = Counter()
    for (a, b), n in edges.items():
        both[a, b] += n
        both[b, a] += n
    got = {(r[2], r[1]): [int(x) for x in r[3].split()] for r in rows(spark, sf, name)}
    assert got == {(s, p): plain_walk(both, s, p, 6, 66, restart, name == "weighted_walks") for s in {a for a, _ in both} for p in range(1, passes + 1)}


def test_walks_with_small_pieces_and_many_writes(spark, monkeypatch):
    """A node whose targets stand in several rows; walks that end; steps in several writes."""
    from riskloom.operators import graph

    monkeypatch.setattr(graph, "PIECE", 4)
    monkeypatch.setattr(graph, "WRITTEN", 2)
    edges = [(0, i, float(i)) for i in range(1, 40)] + [(i, 0, 1.0) for i in range(1, 20)] + [(50, 51, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    known = {(a, b) for a, b, _ in edges}
    for weighted in (False, True):
        got = [tuple(r) for r in graph.random_walks(df, 20, 7, weighted=weighted).collect()]
        assert got and Counter(r[2] for r in got) == dict.fromkeys({n for e in known for n in e}, 20)
        for _, _, start, nodes in got:
            assert nodes[0] == start and set(zip(nodes, nodes[1:], strict=False)) <= known
            assert len(nodes) == 7 or not any(a == nodes[-1] for a, _ in known)
        seen = Counter(n[1] for _, _, s, n in got if s in range(1, 20) and len(n) > 1)
        assert seen == {0: 19 * 20}
        visited = Counter(b for _, _, _, n in got for a, b in zip(n, n[1:], strict=False) if a == 0)
        low, high = sum(visited[i] for i in range(1, 20)), sum(visited[i] for i in range(21, 40))
        assert (high > 1.8 * low) if weighted else (0.8 < high / low < 1.25)


def test_embeddings_of_every_node_of_all_order_lines(spark, sf, edges):
    got = rows(spark, sf, "deepwalk_embeddings")
    assert sorted(int(n) for n, _ in got) == sorted({n for e in edges for n in e})
    assert {len(v) for _, v in got} == {16} and np.isfinite([v for _, v in got]).all()


def test_embeddings_tell_cliques_apart(spark):
    from riskloom.operators import graph

    pairs = [(a, b, 1.0) for k in (0, 100) for a in range(k, k + 8) for b in range(k, k + 8) if a != b]
    walks = graph.random_walks(spark.createDataFrame(pairs, "src long, dst long, weight double"), 40, 10)
    vectors = {int(r["node"]): np.array(r["vector"]) for r in graph.walk_embeddings(walks, 8, 3, iterations=5).collect()}
    unit = {n: v / np.linalg.norm(v) for n, v in vectors.items()}
    near = np.mean([unit[a] @ unit[b] for a, b, _ in pairs])
    assert near > np.mean([unit[a] @ unit[b + 100] for a in range(8) for b in range(8)]) + 0.3


def test_principal_components_against_numpy(spark, sf):
    got = {r[0]: r[1] for r in rows(spark, sf, "pca_embeddings")}
    table = connect(sf).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.array([v for _, v in table], float)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want, own = (x - x.mean(0)) @ axes[:8].T, np.array([got[i] for i, _ in table])
    assert np.abs(np.abs(own) - np.abs(want)).max() < 1e-6


def test_early_stopping_uses_fewer_rounds(spark):
    from riskloom.operators import learn

    random = np.random.default_rng(0)
    data = [(i, float(x), float(random.random() < 0.5), i % 3 == 0) for i, x in enumerate(random.normal(size=600))]
    df = learn.assembled(spark.createDataFrame(data, "uid int, x double, label double, held boolean"), ["x"])
    whole, early = learn.boosted(rounds=12, depth=3).fit(df), learn.boosted(rounds=12, depth=3, stop_early=True).fit(df)
    assert early.getNumTrees < whole.getNumTrees == 12


def test_folds_are_equal_within_labels_and_medians_exact(spark):
    from riskloom.operators import learn

    data = [(i, i % 3 if i % 7 else None, None if i % 5 == 0 else float(i * i % 101)) for i in range(500)]
    df = spark.createDataFrame(data, "uid int, tag int, x double")
    got = [tuple(r) for r in learn.with_folds(df, "uid", "tag", 4).collect()]
    assert sorted(r[0] for r in got) == list(range(500))
    for label in (0, 1, 2, None):
        sizes = Counter(r[3] for r in got if r[1] == label)
        assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1
    filled = {r[0]: r[1] for r in learn.median_filled_exact(df.select("uid", "x"), ["x"]).collect()}
    assert filled == {i: np.median([x for _, _, x in data if x is not None]) if x is None else x for i, _, x in data}


TURNS = [(1, 1000, "Über café naïve"), (2, 0, "café a bc bc"), (3, 0, None), (4, 0, "漢字 x"), (4, 1, "snake_case 12 ½½"), *((i, 0, "same two words") for i in range(5, 15))]


def test_terms_of_all_turns(spark, sf, tmp_path):
    turns = [(i, t, x) for i, t, x in connect(sf).execute("SELECT conv_id, turn, text FROM conversations").fetchall()]
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, own in ((sf, turns), (str(tmp_path), TURNS)):
        tokens = {(i, t): re.findall(r"\b\w\w+\b", (x or "").lower()) for i, t, x in own}
        counts = {key: Counter(words) for key, words in tokens.items()}
        assert {(i, t, w): n for i, t, w, n in rows(spark, folder, "bow_counts")} == {(*key, w): n for key, c in counts.items() for w, n in c.items()}
        df = Counter(w for c in counts.values() for w in c)
        weight = {(*key, w): n * (math.log((1 + len(own)) / (1 + df[w])) + 1) for key, c in counts.items() for w, n in c.items()}
        length = Counter()
        for (i, t, _), x in weight.items():
            length[i, t] += x * x
        got = {(i, t, w): x for i, t, w, x in rows(spark, folder, "tfidf_l2")}
        assert got == pytest.approx({k: x / math.sqrt(length[k[:2]]) for k, x in weight.items()}, abs=2e-6)
        pairs = Counter(w for words in tokens.values() for w in {*words, *map(" ".join, zip(words, words[1:], strict=False))})
        assert dict(rows(spark, folder, "ngram_df")) == {w: n for w, n in pairs.items() if 5 <= n <= 0.8 * len(own)}


def test_walks_and_vectors_of_all_users_and_merchants(spark, sf):
    lines = connect(sf).execute("SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    users, merchants = {u for u, _ in lines}, {m for _, m in lines}
    code = {m: -1_000_000 - i for i, m in enumerate(sorted(merchants, key=str))}
    edges = {(u, code[m]) for u, m in lines}
    got = [tuple(r) for r in QUERIES["user_merchant_walks"](spark, sf, steps=4).collect()]
    assert Counter(r[2] for r in got) == dict.fromkeys(users | set(code.values()), 80)
    assert all(len(r[3]) == 4 and all((max(e), min(e)) in edges for e in zip(r[3], r[3][1:], strict=False)) for r in got)
    vectors = QUERIES["user_merchant_embeddings"](spark, sf, passes=2, steps=4).collect()
    assert {int(r["node"]) for r in vectors} == users | set(code.values()) and {len(r["vector"]) for r in vectors} == {64}
