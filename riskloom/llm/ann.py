"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled into the unit ball and lifted onto the unit sphere by one
more coordinate, so that the largest inner product is the smallest Euclidean
distance.  A table's hash is ``m`` Gaussian projections, each cut into
``CELLS`` cells of equal width (the outer ones open), so a table never has
more than CELLS ** m buckets.  For a query, the projection of a neighbour at
the expected distance is normal, which gives every bucket its chance to hold
the neighbour; buckets are visited from the most likely one until the chances
reach ``SUCCESS``.  The candidates of all tables are merged and ranked by
their exact inner products.

Buckets are packed into groups of bounded size, and larger ones are cut into
several groups, so a bucket with a third of all rows spreads over many tasks.
Queries are dealt into slices of bounded size, and a group's rows go to each
slice, so a task never holds more than one group and one slice.  A query goes
once to each group that holds a bucket it visits, with one bit for each bucket
of that group, and each group returns its ``k`` best rows of these buckets.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import table
from riskloom.sources.storage import materialise

K = 20
TABLES = 2
CELLS = 4
WIDTH = 0.9
SUCCESS = 0.85
SAMPLE = 4000
#: Rows of a group, and queries of a slice, at least and at most; between them, an
#: eighth of the rows and half of the queries, as each query gets its best rows of each group.
GROUP_ROWS = (256, 65_536)
SLICE_QUERIES = (512, 4096)
QUERIES_AT_ONCE = 64
SEED = 7
_erf = np.vectorize(math.erf, otypes=[float])


def _projections(n: int, size: int) -> list[np.ndarray]:
    """Gaussian directions of each table; more of them for more rows."""
    m = int(np.clip(round(math.log2(max(n, 2)) / 5.2), 2, 8))
    random = np.random.default_rng(SEED)
    return [random.standard_normal((size + 1, m)) for _ in range(TABLES)]


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    scaled = vectors / largest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))])


def _cells(projected: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(projected / WIDTH) + CELLS // 2, 0, CELLS - 1).astype(np.int64)


def bucket_codes(vectors: np.ndarray, largest: float, directions: np.ndarray) -> np.ndarray:
    cells = _cells(_lifted(vectors, largest) @ directions)
    return cells @ (CELLS ** np.arange(directions.shape[1]))


def bucket_chances(queries: np.ndarray, directions: np.ndarray, near: tuple[float, float, float]) -> np.ndarray:
    """For each query and bucket: the chance that a neighbour lies there.

    ``near``: a neighbour's expected cosine, and the mean and variance of its
    lifted coordinate; the rest of it is taken as random.
    """
    cosine, height, variance = near
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    centre = cosine * (unit @ directions[:-1]) + height * directions[-1]
    edges = WIDTH * (np.arange(1, CELLS) - CELLS // 2)
    spread = np.sqrt(max(1e-6, 1 - cosine**2 - height**2) + variance * directions[-1] ** 2)[:, None]
    below = 0.5 * (1 + _erf((edges - centre[..., None]) / (spread * math.sqrt(2))))
    cell = np.diff(np.concatenate([np.zeros((*centre.shape, 1)), below, np.ones((*centre.shape, 1))], axis=2), axis=2)
    out = np.ones((len(queries), 1))
    for j in range(directions.shape[1]):
        out = (cell[:, j, :, None] * out[:, None, :]).reshape(len(queries), -1)
    return out


def visits(chances: np.ndarray, counts: np.ndarray, least: int) -> list[np.ndarray]:
    """Per query: the buckets to visit, most likely first, until the chances
    reach ``SUCCESS`` and the buckets hold ``least`` rows."""
    out = []
    for row in chances:
        order = np.argsort(-row, kind="stable")
        order = order[counts[order] > 0]
        if not len(order):
            out.append(order)
            continue
        sure = 1 - row.sum() + row[order].sum()
        reached = np.cumsum(row[order]) >= SUCCESS * sure
        enough = np.cumsum(counts[order]) >= least
        stop = np.argmax(reached & enough) if (reached & enough).any() else len(order) - 1
        out.append(order[: stop + 1])
    return out


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs])


def _best(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, low: int) -> pd.DataFrame:
    """Of one group, whose buckets begin at ``low``: each query's ``k`` best
    rows among the buckets it visits, with ties to the smaller id.  The matrix
    product only preselects; scores are summed alike for equal vectors."""
    if not len(candidates) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    rows, ids = _matrix(candidates["vector"]), candidates["vec_id"].to_numpy(np.int64)
    bucket = candidates["place"].to_numpy(np.int64) - low
    unique = len(np.unique(ids)) == len(ids)
    out = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries.iloc[at : at + QUERIES_AT_ONCE]
        asked = _matrix(part["vector"])
        rough = asked @ rows.T
        slack = 1e-9 * (1 + np.abs(rough).max())
        seen = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in part["visited"]]), axis=1).astype(bool)
        rough[~seen[:, bucket]] = -np.inf
        # With repeated ids the first rows may be of fewer ids than k.
        nth = min(k + 1, len(ids)) if unique else len(ids)
        floor = np.partition(rough, len(ids) - nth, axis=1)[:, len(ids) - nth] - slack
        for i, query_id in enumerate(part["query_id"]):
            near = np.flatnonzero((rough[i] >= floor[i]) & (rough[i] > -np.inf))
            near = near[ids[near] != query_id]
            score = (rows[near] * asked[i]).sum(axis=1)
            top = np.lexsort((ids[near], -score))
            if not unique:
                top = top[np.sort(np.unique(ids[near][top], return_index=True)[1])]
            top = top[:k]
            out.append((np.full(len(top), query_id), ids[near][top], score[top]))
    query, vec, score = map(np.concatenate, zip(*out, strict=True))
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})


def group_buckets(sizes: np.ndarray, buckets: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group, and number of groups, of each bucket, for groups of ``rows``;
    no group spans two tables, so it never holds a row twice."""
    parts = np.maximum(1, -(-sizes // rows))
    first, group, held = np.zeros(len(sizes), np.int64), 0, 0
    for place, size in enumerate(sizes.tolist()):
        if held and (held + size > rows or place % buckets == 0):
            group, held = group + 1, 0
        first[place] = group
        if parts[place] > 1:
            group, held = group + int(parts[place]), 0
        else:
            held += size
    return first, parts


def group_ranges(first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of each group, and the one after its last."""
    place = np.repeat(np.arange(len(first)), parts)
    group = np.repeat(first, parts) + np.arange(len(place)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.full(group.max() + 1, len(first)), np.zeros(group.max() + 1, np.int64)
    np.minimum.at(low, group, place)
    np.maximum.at(high, group, place + 1)
    return low, high


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as little-endian doubles) of the rows that take part: an
    id, and a vector that is not null, empty or zero and has only finite
    components.  Equal rows are one."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = (
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vector": [np.asarray(x, "<f8").tobytes() for x in pdf["v"]]})

    return rows.where(good).mapInPandas(pack, "vec_id long, vector binary").distinct()


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that meets the condition ``is_query`` (a function of the id
    column): its ``k`` nearest other rows, as query_id, rank (from 1), vec_id, score.

    Rows without a usable vector (see ``usable``) take no part; vectors are
    searched among those of their length; an id with several vectors asks with
    each and is found by each, once, with its best score; ties go to the
    smaller id; with fewer rows than ``k`` all are returned; other columns are
    ignored; no rows give no rows.
    """
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    ids = rows.groupBy(F.octet_length("vector").alias("bytes"), "vec_id").agg(F.count("*").alias("n"))
    sizes = ids.groupBy("bytes").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(is_query(F.col("vec_id")), F.col("n")).otherwise(0)).alias("asked")).where("asked > 0").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_found(rows.where(F.octet_length("vector") == r["bytes"]), is_query, k, r["n"], r["asked"], r["most"], r["bytes"] // 8) for r in sorted(sizes)]
    best = reduce(DataFrame.unionAll, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, is_query, k: int, n: int, n_asked: int, most: int, size: int) -> DataFrame:
    """(query_id, vec_id, score): what each group of buckets returns, for the
    ``n`` rows (vec_id, vector) of ``size`` components, ``n_asked`` of which
    ask, at most ``most`` of an id."""

    def norms(batches):
        for pdf in batches:
            yield pd.DataFrame({"norm": np.linalg.norm(_matrix(pdf["vector"]), axis=1) if len(pdf) else []})

    largest = float(rows.mapInPandas(norms, "norm double").agg(F.max("norm")).first()[0])
    sample = _matrix(r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vector").limit(SAMPLE).select("vector").collect())
    near = expected_neighbour(sample, largest, n, k)
    directions = _projections(n, size)
    buckets = CELLS ** directions[0].shape[1]

    def places(vectors: np.ndarray):
        for t, d in enumerate(directions):
            yield t * buckets + bucket_codes(vectors, largest, d)

    def counted(batches):
        total = np.zeros(TABLES * buckets, np.int64)
        for pdf in batches:
            for place in places(_matrix(pdf["vector"])) if len(pdf) else ():
                total += np.bincount(place, minlength=len(total))
        yield pd.DataFrame({"place": np.flatnonzero(total), "rows": total[total > 0]})

    # The bucket space is bounded by the cells, so its counts are, too.
    sizes = np.zeros(TABLES * buckets, np.int64)
    for r in rows.mapInPandas(counted, "place long, rows long").groupBy("place").agg(F.sum("rows").alias("rows")).collect():
        sizes[r["place"]] = r["rows"]
    first, parts = group_buckets(sizes, buckets, int(np.clip(n // 8, *GROUP_ROWS)))
    low, high = group_ranges(first, parts)
    slices = -(-n_asked // int(np.clip(n_asked // 2, *SLICE_QUERIES)))

    def marks(pdf: pd.DataFrame) -> np.ndarray:
        """A number for each row; of the vector too, as one id may have many."""
        own = pdf["vec_id"].to_numpy(np.int64).astype(np.uint64) + np.fromiter(map(zlib.crc32, pdf["vector"]), np.uint64, len(pdf))
        return own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)

    def hashed(batches):
        for pdf in batches:
            for place in places(_matrix(pdf["vector"])) if len(pdf) else ():
                group = first[place] + (marks(pdf) % parts[place].astype(np.uint64)).astype(np.int64)
                for i in range(slices):
                    yield pd.DataFrame({"group": group, "slice": i, "place": place, "vec_id": pdf["vec_id"], "vector": pdf["vector"]})

    def probes(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                x = _matrix(part["vector"])
                own = (marks(part) % np.uint64(slices)).astype(np.int64)
                seen = [visits(bucket_chances(x, d, near), sizes[t * buckets : (t + 1) * buckets], 10 * k * most) for t, d in enumerate(directions)]
                out = []
                for query_id, vector, i, *orders in zip(part["vec_id"], part["vector"], own, *seen, strict=True):
                    visited = np.concatenate([t * buckets + order for t, order in enumerate(orders)])
                    bits = np.zeros(len(sizes), bool)
                    bits[visited] = True
                    last = first[visited] + parts[visited]
                    groups = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first[visited], last, strict=True)]))
                    out += [(g, i, query_id, vector, np.packbits(bits[low[g] : high[g]]).tobytes()) for g in groups.tolist()]
                yield pd.DataFrame(out, columns=["group", "slice", "query_id", "vector", "visited"])

    index = rows.mapInPandas(hashed, "group long, slice long, place long, vec_id long, vector binary")
    asked = rows.where(is_query(F.col("vec_id"))).mapInPandas(probes, "group long, slice long, query_id long, vector binary, visited binary")
    both = index.groupBy("group", "slice").cogroup(asked.groupBy("group", "slice"))
    return both.applyInPandas(lambda key, c, q: _best(c, q, k, int(low[key[0]])), "query_id long, vec_id long, score double")


def expected_neighbour(sample: np.ndarray, largest: float, n: int, k: int) -> tuple[float, float, float]:
    """Cosine, on the sphere, to a query's ``k``-th neighbour of ``n``, and the
    mean and variance of the lifted coordinate of such neighbours.

    Each sampled query has its own estimate, that quantile of its cosines to
    the sample (the closest one beyond the sample's reach); nine in ten
    queries have a closer neighbour than the result, so a group of equal
    vectors, however large, does not make the search of the others too short.
    """
    if len(sample) < 2:
        return 0.0, 0.0, 1.0
    asked = sample[:: max(1, len(sample) // 500)]
    lifted = _lifted(sample, largest)
    cosine = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ lifted[:, :-1].T
    order = np.argsort(cosine, axis=1)[:, :-1]
    reach = np.quantile(np.take_along_axis(cosine, order, axis=1), 1 - min(1.0, k / max(n - 1, 1)), axis=1)
    heights = lifted[order[:, -max(1, round(len(sample) * k / n)) :], -1]
    return float(np.clip(np.quantile(reach, 0.1), -0.99, 0.999)), float(heights.mean()), float(heights.var())


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)
