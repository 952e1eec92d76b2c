"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton of all normalised test items reads a text word by word and
tracks the longest match that ends there.  A match of a window's length marks
the window's words; the items that hold a window are known for each state.

An automaton is only sent to the tasks for ``PART_BYTES`` of items; a larger
benchmark is cut into parts by hash, an item that is larger by itself into
pieces that share a window less a word.  Each part reads the texts and gives
the hits of its own; the hits of all parts meet by row before any judgement,
so the parts do not show in the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import table
from riskloom.llm.toxicity import keep_rows
from riskloom.sources.storage import materialise

WINDOW = 13
SHARE = 20
PART_BYTES = 2 << 20

_WORD = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lowered), digits and non-ASCII characters."""
    return (text or b"").translate(_WORD).split()


class SuffixAutomaton:
    """Of several word sequences; states are numbered, 0 is the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves), self.length.append(length), self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, w: int) -> int:
        """The state of the sequence at ``last`` with one more word."""
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new


class Benchmark:
    """The automaton of some items, and the windows that end in each state."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        sequences = []
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if ids:
                sequences.append((name, ids))
        self.shortest = min((min(len(ids), window) for _, ids in sequences), default=1)
        automaton = SuffixAutomaton()
        for _, ids in sequences:
            state = 0
            for w in ids:
                state = automaton.extend(state, w)
        self.next, self.link, self.length = automaton.next, automaton.link, automaton.length
        marks: list[dict[int, set[str]]] = [{} for _ in self.next]
        for name, ids in sequences:
            size = min(len(ids), window)
            state, matched = 0, 0
            for w in ids:
                state, matched = self.step(state, matched, w)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    marks[at].setdefault(size, set()).add(name)
        # What ends in a state also ends in all states whose suffix it is.
        self.marks: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(marks)
        for at in sorted(range(1, len(marks)), key=self.length.__getitem__):
            own = tuple((n, frozenset(names)) for n, names in marks[at].items())
            self.marks[at] = tuple(sorted(own + self.marks[self.link[at]], key=lambda x: x[0]))

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The longest suffix, with the word ``w`` read, that occurs in an item."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of hit words, names of items with occurring windows."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.numbers or len(words) < self.shortest:
            return len(words), spans, names
        ids = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        runs = edges.reshape(-1, 2)
        for start, end in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            state = matched = 0
            for i, w in enumerate(ids[start:end].tolist(), start + 1):
                state, matched = self.step(state, matched, w)
                longest = 0
                for size, items in self.marks[state]:
                    if size <= matched:
                        longest = size
                        names |= items
                if longest:
                    first = i - longest
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return len(words), spans, names


def _pieces(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Items (name, text) over ``part_bytes`` in pieces, which hold the same windows."""
    for batch in batches:
        out = []
        for name, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            words = words_of(text) if len(text or b"") > part_bytes else []
            if len(words) <= WINDOW:
                out.append((name, text))
                continue
            step = max(1, part_bytes * len(words) // len(text))
            out += [(name, b" ".join(words[at : at + step + WINDOW - 1])) for at in range(0, len(words) - WINDOW + 1, step)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([t for _, t in out], pa.binary())], names=["name", "text"])


def read_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Benchmark]:
    """The benchmark, in parts of about ``part_bytes`` of text (one part, if it is that small).

    Null and empty texts have no windows; an item without an id is matched
    under the empty name; repeated items count once per id.
    """
    text = F.col(text_col).cast("string").cast("binary")
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text.alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    if parts > 1:
        pieces = rows.mapInArrow(lambda batches: _pieces(batches, part_bytes), "name string, text binary")
        rows = materialise(pieces.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts))), "benchmark", "part")
    for i in range(parts):
        own = (rows.where(F.col("part") == i) if parts > 1 else rows).select("name", "text").collect()
        yield Benchmark(sorted((r[0], bytes(r[1]) if r[1] is not None else b"") for r in own))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_TYPE = "array<struct<start:int,end:int>>"


def matches(docs: DataFrame, benchmark: Benchmark | Iterable[Benchmark], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (start and end of hit
    words) and items (names, sorted as strings).

    A null or empty text has no words; null ids and repeated rows stay; other
    columns are ignored; no rows give no rows; with no items nothing is hit.
    A narrow map for one part.  For more, (id, text) is written once with row
    numbers, each part writes the rows that it hits, and these join by number.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = iter([benchmark] if isinstance(benchmark, Benchmark) else benchmark)
    first, second = next(parts, None), next(parts, None)
    first = Benchmark([]) if first is None else first
    if second is None:
        return _hits(rows, first).select("doc_id", "n_words", "spans", "items")
    rows, row = _numbered(rows)
    return _all_hits(rows, row, chain((first, second), parts)).drop(row)


def _all_hits(rows: DataFrame, row: str, parts: Iterator[Benchmark]) -> DataFrame:
    """doc_id, ``row``, n_words, spans, items of numbered rows (doc_id, text), by all parts."""
    found = [materialise(_hits(rows, next(parts), row), "decontamination-hits")]
    for part in parts:
        found.append(materialise(_hits(rows, part, row).where(F.size("items") > 0).drop("doc_id", "n_words"), "decontamination-hits"))
    more = reduce(DataFrame.unionAll, found[1:]).groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    joined = found[0].join(more, row, "left")
    spans = F.concat("spans", F.coalesce("more_spans", F.array().cast(_SPANS_TYPE)))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
    return joined.select("doc_id", row, "n_words", _merged(spans).alias("spans"), items.alias("items"))


def _merged(spans: Column) -> Column:
    """Spans that overlap or touch as one."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (s["start"] <= F.get(out, F.size(out) - 1)["end"]), grown).otherwise(F.array_append(out, s))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS_TYPE), add)


def _hits(rows: DataFrame, benchmark: Benchmark, row: str | None = None) -> DataFrame:
    """What one part hits in rows (doc_id, text): doc_id, [row,] n_words, spans, items."""
    sent = rows.sparkSession.sparkContext.broadcast(benchmark)
    own = ["doc_id", *([row] if row else [])]
    rows = rows.select(*own, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = sent.value.hits
        for batch in batches:
            found = list(map(hits, batch.columns[-1].to_pylist()))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in x] for _, x, _ in found], _SPANS), pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string())),
            ], names=[*own, "n_words", "spans", "items"])

    schema = T.StructType([*rows.drop("text").schema.fields, *T.StructType.fromDDL(f"n_words long, spans {_SPANS_TYPE}, items array<string>").fields])
    return rows.mapInArrow(run, schema)


def is_contaminated(n_words: int, spans: list[tuple[int, int]], share: int = SHARE) -> bool:
    """Whether the hit words are a ``share``-th of the text or more."""
    n_hit = sum(b - a for a, b in spans)
    return n_hit > 0 and share * n_hit >= n_words


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit words and what stands between them."""
    if not spans:
        return text
    marked = text.translate(_WORD)
    inside = np.frombuffer(marked, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : edges[a, 0]])
        at = edges[b - 1, 1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: Benchmark | Iterable[Benchmark], text_col: str = "text", least_words: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` with all columns, without contaminated documents (hit words are a
    ``share``-th of all or more) and, in the rest, without hit spans of
    ``least_words`` words or more.  Null texts stay.  A benchmark in several
    parts counts as one."""
    parts = iter([benchmark] if isinstance(benchmark, Benchmark) else benchmark)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs
    names, place = docs.columns, docs.columns.index(text_col)
    if second is None:
        rows, sent = docs, docs.sparkSession.sparkContext.broadcast(first)
    else:
        rows, row = _numbered(docs)
        texts = rows.select(F.lit(None).cast("long").alias("doc_id"), row, F.col(text_col).cast("string").cast("binary").alias("text"))
        found = _all_hits(texts, row, chain((first, second), parts)).where(F.size("spans") > 0)
        n_words, spans = f"{row}n", f"{row}spans"
        while {n_words, spans} & set(docs.columns):
            n_words, spans = n_words + "_", spans + "_"
        found = found.select(row, F.col("n_words").alias(n_words), F.col("spans").alias(spans))
        rows, sent = rows.join(found, row, "left").select(*docs.columns, n_words, spans), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            data = [None if text is None else text.encode() for text in batch.column(place).to_pylist()]
            if sent is not None:
                judged = [sent.value.hits(text)[:2] for text in data]
            else:
                judged = [(n or 0, [(s["start"], s["end"]) for s in own or ()]) for n, own in zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist(), strict=True)]
            for text, before, (n, spans) in zip(data, batch.column(place).to_pylist(), judged, strict=True):
                kept.append(not is_contaminated(n, spans, share))
                long = [(a, b) for a, b in spans if b - a >= least_words]
                texts.append(cut_spans(text, long).decode("utf-8", "replace") if long else before)
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def _hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, and the name of its column."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows"), row


def without_contaminated(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and any others) without contaminated documents;
    all others stay whole. Each row is judged by itself and once, by the hits
    of all parts of the benchmark."""
    parts = read_parts(items, part_bytes=part_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _kept(docs, first)
    rows, row = _numbered(docs)
    texts = rows.select("doc_id", row, F.col("text").cast("string").cast("binary").alias("text"))
    found = _all_hits(texts, row, chain((first, second), parts)).where(_contaminated(_hit_words()))
    return rows.join(found.select(row), row, "left_anti").select(*docs.columns)


def _kept(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(benchmark)

    def keep():
        hits = sent.value.hits
        return lambda texts: [not is_contaminated(*hits(text)[:2]) for text in texts]

    return keep_rows(docs, keep)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), read_parts(table(spark, sf_dir, "benchmark")))
    rows = found.withColumn("n_hit", _hit_words())
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"),
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts the hit spans of ``WINDOW`` words or
    more from the others; n_chars, where there is one, is counted again.

    Each row is judged by its own text, whatever its id; null and empty texts
    stay; repeated rows stay or go together; all columns are kept; no rows
    give no rows; with no items nothing is changed.
    """
    kept = remove_spans(docs, read_parts(table(spark, sf_dir, "benchmark")))
    if "n_chars" not in docs.columns:
        return kept
    counted = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return kept.withColumn("n_chars", counted)
