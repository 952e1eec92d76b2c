"""Queries on user-attribute graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph
from riskloom.operators.profiles import keyed
from riskloom.operators.relational import label_codes
from riskloom.plans.registry import PAYMENTS, finish, finished, query
from riskloom.sources.storage import materialise
from riskloom.sources.tables import load, payments

_CODED = f"""WITH {PAYMENTS}, n AS (SELECT uid, market, count(*) AS n FROM p WHERE market IS NOT NULL GROUP BY ALL), c AS (SELECT market, row_number() OVER (ORDER BY market) - 1 + 1000000 AS node FROM (SELECT DISTINCT market FROM n))
 SELECT uid, node, n / CAST(sum(n) OVER (PARTITION BY market) AS DOUBLE) AS ratio FROM n JOIN c USING (market)"""
#: Nations linked by a customer of one and a supplier of the other on an order line.
EDGES = """e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def nation_edges(spark, sf):
    """The edges of all order lines."""
    lines, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    customers, suppliers = load(spark, sf, "customer"), load(spark, sf, "supplier")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query(finished(_CODED, "uid", "node", digits=8))
def edge_list_ratio(spark, sf):
    rows = graph.bipartite_edges(payments(spark, sf), "uid", "market").withColumn("node", F.col("node").cast("long"))
    return finish(rows, "uid", "node", digits=8)


@query(f"WITH {EDGES} SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src, dst")
def undirected_edges(spark, sf):
    return graph.undirected(nation_edges(spark, sf))


@query(f"WITH {EDGES} SELECT src AS node, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS neighbours FROM e GROUP BY src")
def adjacency_list(spark, sf):
    rows = graph.adjacency(nation_edges(spark, sf))
    return rows.select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query(f"WITH {EDGES} SELECT src AS node, count(DISTINCT dst) AS degree FROM e GROUP BY src")
def node_degree(spark, sf):
    return graph.degrees(nation_edges(spark, sf))


@query(f"WITH {EDGES} SELECT src, dst, weight FROM e WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def subgraph_edges(spark, sf):
    nodes = load(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.subgraph(nation_edges(spark, sf), nodes)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM e WHERE src <> dst")
def edges_without_loops(spark, sf):
    return graph.without_loops(nation_edges(spark, sf))


@query(f"WITH {EDGES} SELECT count(*) FILTER (src = dst) AS loops FROM e")
def self_loops(spark, sf):
    return graph.has_loops(nation_edges(spark, sf))


@query(f"WITH {EDGES} SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM e)) AS edges")
def graph_order(spark, sf):
    return graph.graph_size(nation_edges(spark, sf))


@query(f"WITH {EDGES}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst FROM nation) SELECT q.src, q.dst, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS present FROM q LEFT JOIN e ON q.src = e.src AND q.dst = e.dst")
def edge_lookup(spark, sf):
    pairs = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("dst"))
    return graph.has_edges(nation_edges(spark, sf), pairs)


@query("SELECT a.i AS src, b.i AS dst, 1.0::DOUBLE AS weight FROM generate_series(0, 11) AS a(i), generate_series(0, 11) AS b(i) WHERE a.i <> b.i")
def clique_pairs(spark, sf):
    return graph.clique(12, spark)


@query()
def random_walks(spark, sf):
    """Uniform walks; each choice is a hash, so every run gives the same rows."""
    walks = graph.random_walks(graph.undirected(nation_edges(spark, sf)), passes=3, steps=6)
    return walks.select("walk", "pass", "start", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"))


@query()
def weighted_walks(spark, sf):
    walks = graph.random_walks(graph.undirected(nation_edges(spark, sf)), passes=2, steps=6, restart=0.1, weighted=True)
    return walks.select("walk", "pass", "start", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"))


@query()
def second_order_walks(spark, sf):
    """Walks that turn back rarely and stay near the node before."""
    walks = graph.second_order_walks(graph.undirected(nation_edges(spark, sf)), passes=2, steps=5, p=4.0, q=0.5, weighted=True)
    return walks.select("walk", "pass", "start", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"))


@query()
def deepwalk_embeddings(spark, sf):
    walks = graph.random_walks(graph.undirected(nation_edges(spark, sf)), passes=4, steps=8)
    return graph.walk_embeddings(walks, size=16)


def user_merchant_edges(spark, sf):
    """Both directions between all users and their merchants, which stand as
    negative numbers, so that no user's id meets them."""
    pairs = materialise(keyed(payments(spark, sf), "uid", "merchant").select("uid", "merchant").distinct(), "user-merchants")
    coded = label_codes(pairs.select("merchant").distinct(), "merchant", "node", graph.FIRST_ATTRIBUTE)
    rows = materialise(pairs.join(coded, "merchant").select(F.col("uid").cast("long").alias("src"), (-F.col("node")).cast("long").alias("dst")), "user-merchant-edges")
    return rows.unionAll(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query()
def user_merchant_walks(spark, sf, passes=80, steps=40):
    """The walks of DeepWalk over users and merchants."""
    return graph.random_walks(user_merchant_edges(spark, sf), passes, steps).select("walk", "pass", "start", "nodes")


@query()
def user_merchant_embeddings(spark, sf, passes=80, steps=40, size=64, window=5):
    """DeepWalk vectors of all users and merchants."""
    walks = graph.random_walks(user_merchant_edges(spark, sf), passes, steps, mixed=True)
    return graph.walk_embeddings(walks, size, window)
