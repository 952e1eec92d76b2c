"""Near-duplicate groups by SimHash and a binary-trie self-join.

Fingerprints link at two or fewer differing bits.  The 64 bits are cut into
six blocks; two linked fingerprints agree in four whole blocks at least, so
each fingerprint goes, for each choice of four blocks, to the task of their
value.  There the fingerprints that share these blocks form a trie over the
other 20 to 22 bits (never more than 2^22 leaves), and pairs of its nodes are
traversed together from the root: bits that differ add up, and a pair over
the budget is dropped with all below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, table
from riskloom.llm.components import components
from riskloom.sources.storage import materialise

SHINGLE = 3
BUDGET = 2
BLOCKS = (11, 11, 11, 11, 10, 10)
KEPT = len(BLOCKS) - BUDGET
CHUNK = 100_000
FRONTIER = 1_000_000

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if it is set in over half of the hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _hash(b" ".join(words))
    ones = np.zeros(64, np.int64)
    total = len(words) - SHINGLE + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False))
        hashes = np.fromiter(map(_hash, shingles), np.uint64, min(CHUNK, total - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the last column, becomes its fingerprint."""
    for batch in batches:
        marks = np.fromiter(map(fingerprint, batch.columns[-1].to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks.view(np.int64))], names=[*batch.schema.names[:-1], "mark"])


# ------------------------------------------------------------ trie self-join
_OFFSETS = np.concatenate(([0], np.cumsum(BLOCKS)))
CHOICES = [
    ([b for b in chosen] + [b for b in range(len(BLOCKS)) if b not in chosen], sum(BLOCKS[b] for b in chosen))
    for chosen in combinations(range(len(BLOCKS)), KEPT)
]


def arranged(marks: np.ndarray, order: list[int]) -> np.ndarray:
    """The fingerprints with their blocks in another order, the first one on top."""
    out = np.zeros_like(marks)
    for b in order:
        low = np.uint64(64 - _OFFSETS[b + 1])
        out = (out << np.uint64(BLOCKS[b])) | ((marks >> low) & np.uint64((1 << BLOCKS[b]) - 1))
    return out


def trie_pairs(keys: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct 64-bit keys that agree in their first
    ``depth`` bits and differ in ``budget`` bits at most."""
    if not len(keys):
        return
    top = keys >> np.uint64(64 - depth) if depth else np.zeros_like(keys)
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    ends = np.append(starts[1:], len(keys))
    many = ends - starts > 1
    # A node is a range of keys; a frontier row is a pair of nodes and their differing bits.
    stack = [(depth, np.stack([starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64)]))]
    while stack:
        level, rows = stack.pop()
        if not rows.shape[1]:
            continue
        if rows.shape[1] > FRONTIER:
            half = rows.shape[1] // 2
            stack += [(level, rows[:, :half]), (level, rows[:, half:])]
            continue
        single = (rows[1] - rows[0] == 1) & (rows[3] - rows[2] == 1)
        a, b = rows[0, single], rows[2, single]
        near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
        if near.any():
            yield a[near], b[near]
        a0, a1, b0, b1, errors = rows[:, ~single]
        if level == 64 or not len(a0):
            continue
        bit = np.uint64(63 - level)
        am, bm = (_middle(keys, lo, hi, bit) for lo, hi in ((a0, a1), (b0, b1)))
        self_pair = a0 == b0
        cross = ~self_pair
        parts = [
            np.stack([a0, am, b0, bm, errors]),
            np.stack([am, a1, bm, b1, errors]),
            np.stack([a0, am, bm, b1, errors + 1]),
            np.stack([am, a1, b0, bm, errors + 1])[:, cross],
        ]
        rows = np.concatenate(parts, axis=1)
        full = (rows[1] > rows[0]) & (rows[3] > rows[2]) & (rows[4] <= budget)
        full &= (rows[0] != rows[2]) | (rows[1] - rows[0] > 1)
        stack.append((level + 1, rows[:, full]))


def _middle(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the keys of each range begin to have the bit set: bisection in all ranges at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(0).to_numpy().view(np.uint64)
        for choice, (order, depth) in enumerate(CHOICES):
            keys = arranged(marks, order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), choice, np.int32)), pa.array((keys >> np.uint64(64 - depth)).view(np.int64)), pa.array(marks.view(np.int64))], names=["choice", "shared", "mark"]
            )


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge per node, to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(2).to_numpy()) for b in batches]
    if not parts:
        return
    choices, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = []
    for choice, (order, depth) in enumerate(CHOICES):
        own = marks[choices == choice].view(np.uint64)
        keys = arranged(own, order)
        by = np.argsort(keys)
        keys, own = keys[by], own[by].view(np.int64)
        found += [(own[a], own[b]) for a, b in trie_pairs(keys, depth)]
    if found:
        u, v = _stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])


def link_marks(marks: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all linked values of the distinct long column ``mark``."""
    n = partitions(marks.sparkSession)
    return (
        marks.select("mark").mapInArrow(_spread, "choice int, shared long, mark long")
        .repartition(n, "choice", "shared").mapInArrow(_links, "u long, v long")
    )


def _rooted(classes: DataFrame) -> DataFrame:
    """``classes`` (distinct mark, ...) with the smallest mark of the component as ``root``."""
    roots = components(link_marks(classes)).withColumnRenamed("node", "mark")
    return classes.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links reach.

    Texts without words (null, empty) have fingerprint zero and link like any
    other; equal texts always share a component; null ids link too but are
    never the smallest (a component of null ids only is null); repeated rows
    stay; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    marked = materialise(rows.mapInArrow(_fingerprints, "doc_id long, mark long"), "fingerprints")
    rooted = _rooted(materialise(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "classes"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("mark", "component_id")
    return marked.join(named, "mark").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A digest of the whole row; rows with one key are equal in all columns
    (in columns that have no order, such as maps, they may differ)."""
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    parts = [F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string").cast("binary")), *([F.xxhash64(*others).cast("string")] if others else [])]
    return F.md5(F.concat_ws(" ", *(F.coalesce(p, F.lit("-")) for p in parts)).cast("binary"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns and one row of each component: the one with the
    smallest id (null ids come last), of rows with that id the one with the
    smallest digest, so every run keeps the same.  An id may stand on unlike
    texts: rows are told apart by a digest of all columns.

    Texts without words are one component; repeated rows are one; no rows give
    no rows.  The choice is made on (id, digest, fingerprint) alone; texts are
    read twice and shuffled once at most.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, _row_key(docs, id_col, text_col))
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    marked = materialise(rows.mapInArrow(_fingerprints, "doc_id long, key string, mark long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    classes = materialise(marked.groupBy("mark").agg(first.alias("first")), "classes")
    kept = _rooted(classes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked fingerprints; cases as in ``one_of_each``."""
    return one_of_each(docs)
