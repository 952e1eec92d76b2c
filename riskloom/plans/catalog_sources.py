"""Queries that write a text format to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph
from riskloom.plans.catalog_graph import EDGES, nation_edges
from riskloom.plans.registry import query
from riskloom.sources import files, reports
from riskloom.sources.storage import fresh_path
from riskloom.sources.tables import load

_CUSTOMER = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
_CUSTOMER_SQL = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"


def _customers(spark, sf):
    return load(spark, sf, "customer").select(
        F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), "c_mktsegment"
    )


@query(_CUSTOMER_SQL)
def csv_round_trip(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_csv(_customers(spark, sf), path)
    return files.read_csv(spark, path, _CUSTOMER)


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, '编号' || c_name AS c_name FROM customer")
def csv_gbk_round_trip(spark, sf):
    """Chinese texts in GBK, and two of the columns read back."""
    path = fresh_path(spark, "csv-gbk")
    rows = _customers(spark, sf).withColumn("c_name", F.concat(F.lit("编号"), "c_name"))
    files.write_csv(rows, path, "GBK")
    return files.read_csv(spark, path, _CUSTOMER, "GBK", ["c_custkey", "c_name"])


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2 FROM embeddings WHERE embedding IS NOT NULL")
def embedding_text_round_trip(spark, sf):
    path = fresh_path(spark, "vectors")
    rows = load(spark, sf, "embeddings").where("embedding is not null")
    files.write_embeddings(rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), path)
    return files.embedding_columns(files.read_embeddings(spark, path), 3)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM e")
def edge_text_round_trip(spark, sf):
    path = fresh_path(spark, "edges")
    files.fixed_lines(nation_edges(spark, sf), "%d %d %f", "src", "dst", "weight").write.text(path)
    return files.read_edges(spark, path)


@query(f"WITH {EDGES} SELECT src || ' ' || dst || ' {{''weight'': ' || CAST(weight AS VARCHAR) || '}}' AS value FROM e")
def weighted_edge_lines(spark, sf):
    path = fresh_path(spark, "edge-lines")
    files.edge_lines(nation_edges(spark, sf)).write.text(path)
    return spark.read.text(path)


@query(f"WITH {EDGES} SELECT src AS node, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS neighbours FROM e WHERE src <> dst GROUP BY src")
def adjacency_text_round_trip(spark, sf):
    """Lines of a node and its neighbours; reading drops the node itself."""
    path = fresh_path(spark, "adjacency")
    listed = graph.adjacency(nation_edges(spark, sf))
    whole = F.concat(F.array("node"), "neighbours")
    listed.select(F.array_join(F.transform(whole, lambda x: x.cast("string")), " ").alias("value")).write.text(path)
    rows = files.read_adjacency(spark, path).where(F.size("neighbours") > 0)
    return rows.select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query("SELECT CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_orderkey % 7 AS VARCHAR) AS walk FROM orders")
def walk_text_round_trip(spark, sf):
    """Walks go to one folder for each pass, and are read from all folders."""
    path = fresh_path(spark, "walks")
    orders = load(spark, sf, "orders")
    nodes = F.array(F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long"), (F.col("o_orderkey") % 7).cast("long"))
    files.write_walks(orders.select((F.col("o_orderkey") % 3).alias("pass"), nodes.alias("nodes")), path)
    return files.read_walks(spark, path).select(F.array_join("nodes", " ").alias("walk"))


@query("SELECT CAST(count(*) AS BIGINT) AS lines FROM orders")
def text_line_count(spark, sf):
    """Lines of all files that the sink wrote, file by file, then in all."""
    path = fresh_path(spark, "lines")
    load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return files.line_counts(spark, path).agg(F.sum("lines").alias("lines"))


@query("SELECT 'Order ' || o_orderkey AS label, CAST(o_totalprice AS DOUBLE) AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def bar_chart_round_trip(spark, sf):
    """A chart of the fifty largest orders; its bars hold their values."""
    path = fresh_path(spark, "bars") + ".svg"
    rows = load(spark, sf, "orders").select(F.concat(F.lit("Order "), "o_orderkey").alias("label"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")
    reports.write_bars(rows.orderBy(F.desc("value"), "o_orderkey").limit(50), "label", "value", path, "Largest orders")
    return reports.read_bars(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey / CAST(7 AS DOUBLE) END AS part FROM nation")
def sheet_round_trip(spark, sf):
    path = fresh_path(spark, "sheet") + ".xlsx"
    part = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") / F.lit(7.0))
    reports.write_sheet(load(spark, sf, "nation").select("n_nationkey", "n_name", part.alias("part")), path)
    return reports.read_sheet(spark, path, {"n_nationkey": "long", "n_name": "string", "part": "double"})
