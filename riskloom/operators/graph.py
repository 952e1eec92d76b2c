"""Graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.arrays import neighbours
from riskloom.operators import skipgram, walker
from riskloom.operators.profiles import keyed
from riskloom.operators.relational import label_codes
from riskloom.sources.storage import fresh_path, materialise, written

FIRST_ATTRIBUTE = 1_000_000
#: Targets of a node in one row, about; steps of walks between writes.
PIECE = 1024
WRITTEN = 8
#: Links that a worker holds in memory, at 4 bytes each; nodes of walks that a task makes, about.
HELD = 80_000_000
MADE = 8_000_000
#: Nodes of walks that a task learns vectors from, at least.
LEARNT = 4_000_000
#: Nodes of walks over which vectors are learnt in batches.
BATCHED = 4_000_000


def bipartite_edges(df: DataFrame, user: str, attribute: str, first: int = FIRST_ATTRIBUTE) -> DataFrame:
    """(user, node, ratio): attribute values numbered from ``first``, and the
    user's share of the value's rows."""
    counts = keyed(df, user, attribute).groupBy(user, attribute).agg(F.count("*").alias("n"))
    total = counts.groupBy(attribute).agg(F.sum("n").alias("total"))
    coded = label_codes(total, attribute, "node", first)
    return counts.join(coded, attribute).select(user, "node", (F.col("n") / F.col("total")).alias("ratio"))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once each; weights of repeated edges add up."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct targets of each source."""
    return edges.groupBy("src").agg(neighbours(F.collect_set("dst")).alias("neighbours")).withColumnRenamed("src", "node")


def edges_of(adjacent: DataFrame) -> DataFrame:
    return adjacent.select(F.col("node").alias("src"), F.explode("neighbours").alias("dst")).withColumn("weight", F.lit(1.0))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def has_loops(edges: DataFrame) -> DataFrame:
    """One row: the number of loops."""
    return edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    kept = nodes.select("node").distinct()
    return (
        edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi")
        .join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    )


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("degree"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: the number of nodes and of undirected edges."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    return nodes.agg(F.count_distinct("node").alias("nodes")).join(edges.agg(F.count_distinct(pair).alias("edges")))


def has_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``present`` 1 or 0."""
    known = edges.select("src", "dst").distinct().withColumn("present", F.lit(1))
    return pairs.join(known, ["src", "dst"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def clique(size: int, spark) -> DataFrame:
    """All ordered pairs of different nodes below ``size``."""
    nodes = spark.range(size).select(F.col("id").alias("src"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda x: x != F.col("src"))
    return nodes.select("src", F.explode(others).alias("dst")).withColumn("weight", F.lit(1.0))


def _places(edges: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """The targets of each node, in pieces of about ``PIECE``: one row for each,
    (at, piece, pos, dst), or, weighted, one row for a piece, (at, piece, dst,
    upto), with running weights along it; and (at, total, pieces, ends), with
    running weights along the node's pieces."""
    if weighted:
        rows = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    else:
        rows = edges.select("src", "dst", F.lit(1.0).alias("w")).distinct()
    many = rows.groupBy("src").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    rows = rows.join(many, "src").select(F.col("src").alias("at"), F.pmod(F.xxhash64("dst"), F.col("pieces")).alias("piece"), "dst", "w")
    along = Window.partitionBy("at", "piece").orderBy("dst")
    if weighted:
        upto = F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))
        listed = rows.withColumn("upto", upto).groupBy("at", "piece").agg(F.array_sort(F.collect_list(F.struct("dst", "upto"))).alias("next"))
        places = listed.select("at", "piece", F.col("next.dst").alias("dst"), F.col("next.upto").alias("upto"))
    else:
        places = rows.select("at", "piece", (F.row_number().over(along) - 1).cast("long").alias("pos"), "dst")
    places = materialise(places, "walk-places")
    sizes = places.select("at", "piece", F.element_at("upto", -1).alias("w")) if weighted else places.groupBy("at", "piece").agg(F.count("*").cast("double").alias("w"))
    along = Window.partitionBy("at").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    sums = sizes.withColumn("end", F.sum("w").over(along)).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("piece", "end"))).alias("ends"), F.max("end").alias("total"))
    return places, materialise(sums.select("at", "total", F.col("ends.piece").alias("pieces"), F.col("ends.end").alias("ends")), "walk-ends")


def _links(edges: DataFrame) -> tuple[DataFrame, str]:
    """Distinct (src, dst), in order over all files, and their path."""
    path = fresh_path(edges.sparkSession, "walk-links")
    return written(edges.select("src", "dst").repartitionByRange("src", "dst").distinct().orderBy("src", "dst"), path), path


def _held_nodes(links: tuple[DataFrame, str]) -> tuple[DataFrame, str, str] | None:
    """(node, n), in order, with its path and that of the links; None if a
    worker should not hold them or cannot read them."""
    rows, path = links
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("odd")).first()
    if n["n"] > HELD or n["odd"]:
        return None
    try:
        walker.located(path)
    except (OSError, ValueError, ImportError):
        return None
    ends = rows.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).unionAll(rows.select(F.col("dst").alias("node")).distinct().withColumn("n", F.lit(0).cast("long")))
    to = fresh_path(rows.sparkSession, "walk-nodes")
    return written(ends.groupBy("node").agg(F.sum("n").alias("n")).orderBy("node"), to), to, path


def _whole_walks(nodes: DataFrame, at: str, links: str, passes: int, steps: int, seed: int, restart: float, mixed: bool) -> DataFrame:
    spark, total = nodes.sparkSession, nodes.count() * passes
    cores = spark.sparkContext.defaultParallelism
    tasks = ceil(max(total * steps / MADE, 1) / cores) * cores if total >= 1000 else 1
    return spark.range(0, total, 1, tasks).mapInArrow(walker.walker(at, links, PIECE, passes, steps, seed, restart, total if mixed else None), walker.SCHEMA)


def random_walks(edges: DataFrame, passes: int, steps: int, seed: int = 66, restart: float = 0.0, weighted: bool = False, mixed: bool = False) -> DataFrame:
    """(walk, pass, start, nodes): from every node ``passes`` walks of at most
    ``steps`` nodes; a walk ends at a node without edges.

    Each choice is a hash of (seed, walk, step), so a repeated task repeats it.
    Without weights, and up to ``HELD`` links, every worker holds the graph and
    makes its walks whole: nothing is written but the links, and the walks are
    made again by each job that reads them.  Else, with the same results, a step joins the walks' ends with the one target chosen (weighted: with the
    piece that holds it), so a node with a third of all edges is no single row.  Steps carry a walk's last
    ``WRITTEN`` nodes only, are then written, and meet by walk at the end.
    ``weighted`` chooses by edge weight, ``restart`` returns to the start by
    that chance.  Walks made whole come by their start, or ``mixed``, so that
    every part of them has walks from all over the graph; those of steps come by
    their hash.
    """
    if not weighted and dict(edges.dtypes)["src"] == dict(edges.dtypes)["dst"] == "bigint":
        links = _links(edges)
        nodes = _held_nodes(links)
        if nodes:
            return _whole_walks(*nodes, passes, steps, seed, restart, mixed)
        edges = links[0]
    places, ends = _places(edges, weighted)
    starts = edges.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    walks = starts.select("start", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    walks = walks.select(F.xxhash64("start", "pass").alias("walk"), "pass", "start", F.array("start").alias("nodes"), F.col("start").alias("at"))
    parts = []
    for first in range(1, max(steps, 2), WRITTEN):
        for step in range(first, min(first + WRITTEN, steps)):
            walks = _step(walks, places, ends, weighted, seed, step, restart)
        walks = materialise(walks, "walks")
        parts.append(walks.select("walk", "pass", "start", F.lit(first).alias("first"), "nodes"))
        walks = walks.where(F.col("at").isNotNull()).withColumn("nodes", F.array().cast("array<long>"))
    if len(parts) == 1:
        return parts[0].drop("first")
    parts = reduce(DataFrame.unionAll, parts).groupBy("walk", "pass", "start").agg(F.array_sort(F.collect_list(F.struct("first", "nodes"))).alias("parts"))
    return parts.select("walk", "pass", "start", F.flatten("parts.nodes").alias("nodes"))


def _share(own: int, *marks) -> Column:
    """A number from 0 to 1 by the hash of (own, marks)."""
    return F.pmod(F.xxhash64(F.lit(own), *marks), F.lit(1 << 30)) / float(1 << 30)


def _offered(walks: DataFrame, places: DataFrame, ends: DataFrame, weighted: bool, share: Column, own: list[str]) -> DataFrame:
    """The walks' columns ``own`` and ``at`` with the target ``chosen`` by ``share``; null at a node without edges."""

    def place(upto: str, x: Column) -> Column:
        return F.least(F.size(F.filter(upto, lambda c: c <= x)), F.size(upto) - 1)

    found = walks.join(ends, "at", "left").withColumn("x", share * F.col("total")).withColumn("i", place("ends", F.col("x")))
    before = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0.0)
    found = found.select(*own, "at", F.get("pieces", "i").alias("piece"), (F.col("x") - before).alias("x"))
    if weighted:
        found = found.join(places, ["at", "piece"], "left")
        return found.select(*own, "at", F.get("dst", place("upto", F.col("x"))).alias("chosen"))
    found = found.withColumn("pos", F.floor("x")).join(places, ["at", "piece", "pos"], "left")
    return found.select(*own, "at", F.col("dst").alias("chosen"))


def _step(walks: DataFrame, places: DataFrame, ends: DataFrame, weighted: bool, seed: int, step: int, restart: float) -> DataFrame:
    """The walks with one more node."""
    own = ["walk", "pass", "start", "nodes"]
    found = _offered(walks, places, ends, weighted, _share(seed, "walk", F.lit(step)), own)
    back = _share(seed + 1, "walk", F.lit(step)) < restart
    to = F.when(F.col("at").isNotNull(), F.when(back, F.col("start")).otherwise(F.col("chosen")))
    return found.select(*own, to.alias("at")).withColumn("nodes", F.when(F.col("at").isNotNull(), F.array_append("nodes", F.col("at"))).otherwise(F.col("nodes")))


def second_order_walks(edges: DataFrame, passes: int, steps: int, p: float = 1.0, q: float = 1.0, seed: int = 66, weighted: bool = False) -> DataFrame:
    """(walk, pass, start, nodes) as ``random_walks``, but a step from node b,
    reached from a, takes each target by its weight times 1/p if it is a, 1 if
    a has an edge to it, 1/q if not.

    Targets are offered as ``random_walks`` chooses them, and an offer is taken
    by its factor's share of the largest factor, so no node's targets are
    listed for a walk.  A job makes as many offers for a walk as are needed on
    average at most, and the first one taken counts; jobs go on until no walk
    is left without one.
    """
    if p <= 0 or q <= 0:
        raise ValueError("p and q must be over 0")
    factors = [1 / p, 1.0, 1 / q]
    offers = ceil(max(factors) / min(factors))
    places, ends = _places(edges, weighted)
    known = materialise(edges.select(F.col("src").alias("prev"), F.col("dst").alias("chosen")).distinct().withColumn("linked", F.lit(True)), "walk-links")
    starts = edges.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    walks = starts.select("start", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    own = ["walk", "pass", "start"]
    walks = walks.select(F.xxhash64("start", "pass").alias("walk"), "pass", "start", F.lit(None).cast("long").alias("prev"), F.col("start").alias("at"))
    parts = [walks.select(*own, F.lit(0).alias("step"), F.col("at").alias("node"))]
    factor = F.when(F.col("prev").isNull(), max(factors)).when(F.col("chosen") == F.col("prev"), 1 / p).when(F.col("linked"), 1.0).otherwise(1 / q)
    for step in range(1, steps):
        left, taken, first = walks, [], 0
        while True:
            made = left.withColumn("offer", F.explode(F.sequence(F.lit(first), F.lit(first + offers - 1))))
            marks = ["walk", F.lit(step), "offer"]
            made = _offered(made, places, ends, weighted, _share(seed, *marks), [*own, "prev", "offer"]).where("chosen is not null")
            made = made.join(known, ["prev", "chosen"], "left")
            good = _share(seed + 1, *marks) * max(factors) < factor
            made = made.groupBy(*own, "prev", "at").agg(F.min(F.when(good, F.struct("offer", "chosen"))).alias("to"))
            made = materialise(made.select(*own, "prev", "at", F.col("to.chosen").alias("to")), "walk-offers")
            taken.append(made.where("to is not null").select(*own, F.col("at").alias("prev"), F.col("to").alias("at")))
            left, first = made.where("to is null").drop("to"), first + offers
            if left.isEmpty():
                break
        walks = reduce(DataFrame.unionAll, taken)
        parts.append(walks.select(*own, F.lit(step).alias("step"), F.col("at").alias("node")))
    parts = reduce(DataFrame.unionAll, parts).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("parts"))
    return parts.select(*own, F.col("parts.node").alias("nodes"))


def walk_embeddings(walks: DataFrame, size: int = 64, window: int = 5, seed: int = 66, iterations: int = 1) -> DataFrame:
    """(node, vector): skip-gram vectors of the nodes from their walks.

    Up to ``LEARNT`` nodes of walks are learnt from in one task.  More are dealt
    to a task for as many each, one for each core at most; every task learns
    from all of its walks, and after each iteration the tasks' vectors of a
    node are averaged.  Over ``BATCHED`` nodes, with one iteration, a task takes
    its walks as they come, so they should come in no order, and learns by
    ``skipgram``: the same pairs and tree, but steps of a batch of pairs.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    if iterations == 1 and dict(walks.dtypes)["nodes"] == "array<bigint>":
        counts = materialise(walks.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n")), "walk-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
    else:
        counts, total = None, walks.agg(F.sum(F.size("nodes"))).first()[0] or 0
    tasks = max(1, min(ceil(total / LEARNT), walks.sparkSession.sparkContext.defaultParallelism))
    if counts and total > BATCHED:
        return _batch_vectors(walks, counts, total, tasks, size, window, seed)
    words = walks.select(F.transform("nodes", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=iterations, numPartitions=tasks, inputCol="words", outputCol="out").fit(words)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))


def _batch_vectors(walks: DataFrame, counts: DataFrame, total: int, tasks: int, size: int, window: int, seed: int) -> DataFrame:
    """Every task learns by itself; a node's vector is the mean of those of the tasks that met it."""
    rows = counts.toArrow().sort_by("node")
    held = walks.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("node", "n")))
    learnt = walks.select("nodes").coalesce(tasks).mapInArrow(skipgram.learner(lambda: held.value, size, window, seed, total / tasks), skipgram.SCHEMA)
    mean = learnt.repartition("node").groupBy("node").agg(F.array(*(F.avg(F.col("vector")[i]) for i in range(size))).alias("vector"))
    return materialise(mean.select(F.col("node").cast("string").alias("node"), "vector"), "walk-vectors")
