"""Language-model scoring by context-tree weighting over bytes.

A text is a sequence of tokens: its words (separated by ASCII white space,
A-Z lowered), then one end token.  It is predicted byte by byte, each byte as
eight binary decisions: every word is closed by a space, and the end token is
a line feed where a word could start.  The context of a byte is the ``DEPTH``
bytes before it, across words.  Each node of the context tree (context suffix
x bit prefix) holds a Krichevsky-Trofimov estimator; a node's weighted
probability is half its own and half the product of its children's, so the
prediction mixes the estimates of all depths with exact weights learned from
the whole training part.

The work is done once per distinct unit, with no broadcast that grows:

1. each scan task numbers the words of a block of documents.  With the last
   ``TAIL`` bytes before it, a word's first ``TAIL`` bytes see all of their
   context, and its later bytes see only the word, so counting distinct
   (tail, head) pairs and distinct words counts all byte contexts.  The block
   writes its words keyed by word hash, its contexts keyed by their two
   latest bytes, and its documents as word numbers (one written table);
2. words meet by hash for corpus counts, contexts by key, both in two steps,
   first those of a lot of blocks, then the lots.  There are about as many lots
   as the square root of the blocks, however many partitions the session has,
   so neither step gathers all blocks of a frequent word or pair of bytes in
   one task; the second holds the distinct contexts of its part;
3. subtrees of depth two and more are built there, the two levels above (at
   most 65,536 nodes) on the driver;
4. counts and probabilities return to the blocks and are summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import crc_mod, partitions, table
from riskloom.sources.storage import materialise

DEPTH = 5
TAIL = DEPTH - 1
END = b"\n"
BLOCK_BYTES = 9_000_000
TABLE_CELLS = 1 << 25

_ENCODED = "kind string, block long, part int, first binary, second binary, third binary"
_DOC = np.dtype([("id", "<i8"), ("null", "i1"), ("held", "i1"), ("tokens", "<i8"), ("bytes", "<i8")])
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, n_bytes long, bits_per_byte double"
)


def tokenize(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# ------------------------------------------------------- units of a block
def _codes(pieces: list[bytes], width: int) -> np.ndarray:
    """Each piece, cut or zero-padded on the left to ``width`` bytes, as a number."""
    padded = b"".join(p[-width:].rjust(width, b"\0") for p in pieces)
    raw = np.frombuffer(padded, np.uint8).reshape(-1, width).astype(np.uint64)
    out = np.zeros(len(pieces), np.uint64)
    for i in range(width):
        out = (out << np.uint64(8)) | raw[:, i]
    return out


def _tails(words: list[bytes], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token, the ``TAIL`` = 4 bytes of its text before the space that precedes it."""
    spaced = [b" " + w for w in words]
    own = _codes(spaced, TAIL)
    before = _codes(spaced, 2)
    length = np.fromiter(map(len, words), np.int64, len(words))
    space = np.uint64(32)
    one, two = length == 1, length == 2
    own[two] = (space << np.uint64(16)) | (own[two] & np.uint64(0xFFFF))
    own[one] = (space << np.uint64(8)) | (own[one] & np.uint64(0xFF))
    code = np.zeros(len(ids), np.uint64)
    code[1:] = own[ids[:-1]]
    earlier = np.zeros(len(ids), np.uint64)
    earlier[2:] = before[ids[:-2]]
    earlier[starts] = 0
    second = starts + 1
    earlier[second[second < len(ids)]] = 0
    short = np.zeros(len(ids), np.int64)
    short[1:] = length[ids[:-1]]
    code = np.where(short == 1, code | (earlier << np.uint64(16)), code)
    code = np.where(short == 2, code | ((earlier & np.uint64(0xFF)) << np.uint64(24)), code)
    code[starts] = 0
    return code


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the distinct rows of byte columns; also one place of each.
    Direct tables where they are small, sorting else."""
    number = np.zeros(len(columns[0]), np.int32)
    for column in columns:
        symbols = np.unique(column)
        rank = np.zeros(256, np.int32)
        rank[symbols] = np.arange(len(symbols))
        cells = (int(number.max(initial=0)) + 1) * len(symbols)
        if cells <= TABLE_CELLS:
            key = number * np.int32(len(symbols)) + rank[column]
            used = np.zeros(cells, bool)
            used[key] = True
            number = (np.cumsum(used, dtype=np.int32) - np.int32(1))[key]
        else:
            number = np.unique(number.astype(np.int64) * len(symbols) + rank[column], return_inverse=True)[1].astype(np.int32)
    place = np.zeros(int(number.max(initial=-1)) + 1, np.int32)
    place[number] = np.arange(len(number), dtype=np.int32)
    return number, place


class Block:
    """The distinct byte contexts of a block's tokens.

    ``keys``: for each, its ``DEPTH`` context bytes, latest first, then the
    byte that follows, sorted by tree and key.  ``token_sums`` adds up a value
    of each key over the bytes of every token.
    """

    def __init__(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, trees: int):
        self.words, self.ids = words, ids
        closed = [w + b" " if w != END else w for w in words]
        heads: dict[bytes, int] = {}
        head_of = np.fromiter((heads.setdefault(w[:TAIL], len(heads)) for w in closed), np.uint64, len(words))
        pair = (_tails(words, ids, starts) << np.uint64(32)) | head_of[ids]
        pairs, self.pair = np.unique(pair, return_inverse=True)
        self.pairs = len(pairs)
        # One row for each byte of a unit: the unit and the bytes around it.
        names = list(heads)
        head = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.fromiter(map(len, names), np.int64, len(names))
        text = np.frombuffer(b"".join(x.ljust(TAIL, b"\0") for x in names), np.uint8).reshape(-1, TAIL)
        strip = np.concatenate(
            [((pairs[:, None] >> np.arange(56, 24, -8, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8), np.full((len(pairs), 1), 32, np.uint8), text[head]], axis=1
        )
        unit, columns = [], [[] for _ in range(DEPTH + 1)]
        for j in range(TAIL):
            at = np.flatnonzero(size[head] > j)
            unit.append(at.astype(np.int32))
            for back in range(DEPTH + 1):
                columns[back].append(strip[at, j + DEPTH - back])
        long = [i for i, w in enumerate(closed) if len(w) > TAIL]
        if long:
            joined = np.frombuffer(b"".join(b" " + closed[i] for i in long), np.uint8)
            lengths = np.fromiter((len(closed[i]) - TAIL for i in long), np.int64, len(long))
            which = np.repeat(np.arange(len(long)), lengths)
            ends = np.cumsum(lengths + DEPTH)
            position = np.arange(len(which)) - (np.cumsum(lengths) - lengths)[which] + (ends - lengths)[which]
            unit.append((np.array(long)[which] + self.pairs).astype(np.int32))
            for back in range(DEPTH + 1):
                columns[back].append(joined[position - back])
        self.unit = np.concatenate(unit)
        joined_columns = [np.concatenate(c) for c in columns]
        del columns
        number, place = _distinct([*joined_columns[1:], joined_columns[0]])
        keys = np.zeros(len(place), np.uint64)
        for column in (*joined_columns[1:], joined_columns[0]):
            keys = (keys << np.uint64(8)) | column[place].astype(np.uint64)
        self.home = _home(keys, trees, DEPTH)
        order = np.lexsort((keys, self.home))
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.home, self.number = keys[order], self.home[order], rank[number]

    def key_weights(self, learned: np.ndarray) -> np.ndarray:
        """How often each key occurs in the tokens marked ``learned``."""
        weight = np.concatenate([
            np.bincount(self.pair[learned], minlength=self.pairs),
            np.bincount(self.ids[learned], minlength=len(self.words)),
        ])
        return np.bincount(self.number, weight[self.unit], len(self.keys))

    def token_sums(self, values: np.ndarray) -> np.ndarray:
        total = np.bincount(self.unit, values[self.number], self.pairs + len(self.words))
        return total[self.pair] + total[self.pairs + self.ids]


def _pack(x: np.ndarray | bytes) -> bytes:
    return zlib.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _home(keys: np.ndarray, trees: int, depth: int) -> np.ndarray:
    pair = keys >> np.uint64(8 * (depth - 1))
    return ((pair * np.uint64(2654435761)) % np.uint64(1 << 32) % np.uint64(trees)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    starts = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    ends = np.append(starts[1:], len(sorted_values))
    return [(int(sorted_values[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _encode(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 24
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("first", "second", "third"))])

    def encoded(numbers: _Numbers, parts: list[np.ndarray], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        home = np.fromiter((zlib.crc32(w) % slices for w in words), np.int64, len(words))
        order = np.argsort(home, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        ids, words, home = place[np.concatenate(parts)], [words[i] for i in order], home[order]
        docs = np.array(rows, _DOC)
        learned = np.repeat(docs["held"] == 0, docs["tokens"])
        counts = np.bincount(ids[learned], minlength=len(words))
        units = Block(words, ids, np.cumsum(docs["tokens"]) - docs["tokens"], slices)
        weights = units.key_weights(learned)
        out = [("words", block, v, _pack(b" ".join(words[a:b])), _pack(counts[a:b].astype("<i8")), None) for v, a, b in _runs(home)]
        out += [("keys", block, t, _pack(np.diff(units.keys[a:b], prepend=np.uint64(0))), _pack(weights[a:b].astype("<i8")), None) for t, a, b in _runs(units.home)]
        out.append(("docs", block, 0, _pack(b" ".join(words)), _pack(ids.astype("<i4")), docs.tobytes()))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 64], strict=True), schema, strict=True)], schema=schema)

    numbers, parts, rows, held = _Numbers(), [], [], 0
    for batch in batches:
        for doc_id, is_held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = tokenize(text)
            size = sum(map(len, words)) + len(words) + 1
            words.append(END)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            rows.append((doc_id or 0, doc_id is None, bool(is_held), len(words), size))
            held += size
            if held >= BLOCK_BYTES:
                yield from encoded(numbers, parts, rows)
                block, numbers, parts, rows, held = block + 1, _Numbers(), [], [], 0
    if rows:
        yield from encoded(numbers, parts, rows)


# -------------------------------------------------------------- word counts
def _words(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b" ")


def _counts(pdf: pd.DataFrame) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for blob, counts in zip(pdf["first"], pdf["second"], strict=True):
        for w, n in zip(_words(blob), _unpack(counts, "<i8").tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    return total


def _merged_words(pdf: pd.DataFrame) -> pd.DataFrame:
    total = _counts(pdf)
    out = [(pdf["part"].iloc[0], pdf["lot"].iloc[0], _pack(b" ".join(total)), _pack(np.fromiter(total.values(), "<i8", len(total))))]
    return pd.DataFrame(out, columns=["part", "lot", "first", "second"])


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = _counts(pdf).values()
    return pd.DataFrame({"tokens": [sum(counts)], "words": [sum(n > 0 for n in counts)]})


def _lot_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of each lot's words, in their order."""
    total = _counts(pdf)
    values = [_pack(np.fromiter(map(total.__getitem__, _words(blob)), "<i8")) for blob in pdf["first"]]
    return pd.DataFrame({"part": pdf["part"], "lot": pdf["lot"], "first": pdf["first"], "second": values})


def _count_replies(blocks: pd.DataFrame, lot: pd.DataFrame) -> pd.DataFrame:
    total = _counts(lot)
    values = [_pack(np.fromiter(map(total.__getitem__, _words(blob)), "<i8")) for blob in blocks["first"]]
    return pd.DataFrame({"block": blocks["block"], "kind": "words", "part": blocks["part"], "value": values})


# ------------------------------------------------------------- context tree
def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5 (Stirling after a shift)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift -= np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


class Subtrees:
    """All nodes of depth ``low`` to ``depth`` below some contexts.

    Bit prefixes are numbered like a heap: one for the empty prefix, then
    twice the parent plus the bit.
    """

    def __init__(self, keys: np.ndarray, weights: np.ndarray, depth: int, low: int):
        self.depth, self.low = depth, low
        self.keys, self.levels = keys, {}
        grams, at, w = keys, np.arange(len(keys)), weights
        children: list[np.ndarray] | None = None
        for d in range(depth, low - 1, -1):
            if d < depth:
                shorter = ((grams >> np.uint64(16)) << np.uint64(8)) | (grams & np.uint64(255))
                grams, inverse = np.unique(shorter, return_inverse=True)
                w = np.bincount(inverse, w, len(grams))
                at = inverse[at]
            level, products = [], []
            for k in range(8):
                node_of = grams >> np.uint64(8 - k)
                starts = np.flatnonzero(np.concatenate(([True], node_of[1:] != node_of[:-1])))
                index = np.cumsum(np.concatenate(([0], (node_of[1:] != node_of[:-1]).astype(np.int64))))
                bit = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
                ones = np.add.reduceat(np.where(bit, w, 0), starts)
                zeros = np.add.reduceat(np.where(bit, 0, w), starts)
                kt = log_kt(zeros, ones)
                if d == depth:
                    own = np.ones(len(starts))
                    weighted = kt
                else:
                    below = np.bincount(inverse_nodes(children[k], node_of[starts], k), children_w[k], len(starts))
                    own = 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
                    weighted = np.logaddexp(kt, below) - np.log(2)
                level.append((index, (ones + 0.5) / (zeros + ones + 1), own, node_of[starts], zeros, ones))
                products.append(weighted)
            self.levels[d] = (at, level)
            children = [x[3] for x in level]
            children_w = products
        self.grams, self.weighted = grams, children_w

    def top(self) -> tuple[np.ndarray, ...]:
        """Of the parents of the lowest level: number (latest byte x heap index), counts and log product."""
        _, level = self.levels[self.low]
        number, zeros, ones, product = [], [], [], []
        for k, ((_, _, _, nodes, a, b), weighted) in enumerate(zip(level, self.weighted, strict=True)):
            parent = nodes >> np.uint64(k + 8 * (self.low - 1))
            number.append(parent.astype(np.int64) * 256 + (1 << k) + (nodes & np.uint64((1 << k) - 1)).astype(np.int64))
            zeros.append(a), ones.append(b), product.append(weighted)
        return tuple(map(np.concatenate, (number, zeros, ones, product)))

    def log_probability(self, upper: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural log of each key's byte given its context. ``upper``: from
        depth ``low`` - 1 to 0, probability of a one and own weight, by node number."""
        out = np.zeros(len(self.keys))
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        latest = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        for k in range(8):
            p = None
            for d in range(self.depth, self.low - 1, -1):
                at, level = self.levels[d]
                index, one, own = level[k][:3]
                node = index[at]
                p = one[node] if p is None else own[node] * one[node] + (1 - own[node]) * p
            heap = (1 << k) + (byte >> (8 - k))
            for one, own in upper:
                node = latest * 256 + heap if len(one) > 256 else heap
                p = own[node] * one[node] + (1 - own[node]) * p
            bit = (byte >> (7 - k)) & 1
            out += np.log(np.where(bit == 1, p, 1 - p))
        return out


def inverse_nodes(children: np.ndarray, parents: np.ndarray, k: int) -> np.ndarray:
    """Index of each child node's parent: the same node without its oldest context byte."""
    low = np.uint64((1 << k) - 1)
    parent = ((children >> np.uint64(8 + k)) << np.uint64(k)) | (children & low)
    return np.searchsorted(parents, parent)


def upper_levels(number: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of depth one and zero, from the sums over all subtrees."""
    a, b, below = (np.bincount(number, x, 65536) for x in (zeros, ones, product))
    out = []
    for _ in range(2):
        kt = log_kt(a, b)
        out.append(((b + 0.5) / (a + b + 1), 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))))
        weighted = np.where(a + b > 0, np.logaddexp(kt, below) - np.log(2), 0.0)
        if a.size > 256:
            a, b, below = (x.reshape(256, 256).sum(0) for x in (a, b, weighted))
    return out


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


def _gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed weights, and the place of each given key."""
    unique, inverse = np.unique(np.concatenate([_keys(x) for x in pdf["first"]]), return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate([_unpack(x, "<i8") for x in pdf["second"]]), len(unique)), inverse


def _merged_lot(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, weights, _ = _gathered(pdf)
    out = [(pdf["part"].iloc[0], pdf["lot"].iloc[0], _pack(np.diff(keys, prepend=np.uint64(0))), _pack(weights.astype("<i8")))]
    return pd.DataFrame(out, columns=["part", "lot", "first", "second"])


def _tops(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, weights, _ = _gathered(pdf)
    number, zeros, ones, product = Subtrees(keys, weights, DEPTH, 2).top()
    unique, at = np.unique(number, return_inverse=True)
    sums = [np.bincount(at, x, len(unique)) for x in (zeros, ones, product)]
    return pd.DataFrame({"node": unique, "zeros": sums[0], "ones": sums[1], "product": sums[2]})


def _lot_probabilities(pdf: pd.DataFrame, upper: list) -> pd.DataFrame:
    """Log10 probabilities of each lot's keys, in their order."""
    keys, weights, inverse = _gathered(pdf)
    p = (Subtrees(keys, weights, DEPTH, 2).log_probability(upper) / np.log(10))[inverse].astype("<f4")
    ends = np.cumsum([len(_keys(x)) for x in pdf["first"]])
    return pd.DataFrame({"part": pdf["part"], "lot": pdf["lot"], "first": pdf["first"], "logs": [x.tobytes() for x in np.split(p, ends[:-1])]})


def _probability_replies(blocks: pd.DataFrame, lot: pd.DataFrame) -> pd.DataFrame:
    keys, logs = _keys(lot["first"].iloc[0]), np.frombuffer(lot["logs"].iloc[0], "<f4")
    values = [logs[np.searchsorted(keys, _keys(x))].tobytes() for x in blocks["first"]]
    return pd.DataFrame({"block": blocks["block"], "kind": "keys", "part": blocks["part"], "value": values})


def _documents(docs: pd.DataFrame, replies: pd.DataFrame, tokens: int, distinct: int, trees: int) -> pd.DataFrame:
    replies = replies.sort_values("part")
    count = np.concatenate([_unpack(x, "<i8") for x in replies["value"][replies["kind"] == "words"]])
    logs = np.concatenate([np.frombuffer(x, "<f4") for x in replies["value"][replies["kind"] == "keys"]]).astype(float)
    rows, ids = np.frombuffer(docs["third"].iloc[0], _DOC), _unpack(docs["second"].iloc[0], "<i4").astype(np.int64)
    starts = np.cumsum(rows["tokens"]) - rows["tokens"]
    score = Block(_words(docs["first"].iloc[0]), ids, starts, trees).token_sums(logs)
    base = np.log10((count + 1) / (tokens + distinct + 1))
    total = np.add.reduceat(score, starts)
    out = pd.DataFrame({
        "doc_id": pd.array(rows["id"], "Int64"), "held_out": rows["held"] == 1, "n_tokens": rows["tokens"],
        "n_known": np.add.reduceat((count[ids] > 0).astype(np.int64), starts), "train_tokens": tokens,
        "base_score": np.add.reduceat(base[ids], starts), "score": total, "n_bytes": rows["bytes"],
        "bits_per_byte": -total / np.log10(2) / rows["bytes"],
    })
    out.loc[rows["null"] == 1, "doc_id"] = pd.NA
    return out


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text under a model of the rows where ``held_out`` is not true.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known (tokens
    seen in training), train_tokens, base_score (add-one unigram), score (log10
    probability), n_bytes (words, separators and end) and bits_per_byte.

    A null text is empty and scores its end token alone; a null id stays null
    and a null ``held_out`` counts as false; repeated rows are scored (and
    counted) each time; other columns are ignored; no rows give no rows.  A
    corpus without training rows gives the uniform model.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    encoded = materialise(rows.mapInArrow(lambda b: _encode(b, n), _ENCODED), "lm-encoded", "kind")
    texts = encoded.where(F.col("kind") == "docs").drop("kind")
    lot = F.pmod(F.xxhash64("block"), F.lit(math.isqrt(texts.count()) + 1)).cast("int")
    words, keys = (encoded.where(F.col("kind") == k).select("block", "part", "first", "second", lot.alias("lot")) for k in ("words", "keys"))

    merged = "part int, lot int, first binary, second binary"
    word_lots = materialise(words.groupBy("part", "lot").applyInPandas(_merged_words, merged), "lm-words")
    sums = word_lots.groupBy("part").applyInPandas(_totals, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = (x or 0 for x in sums)
    lots = materialise(keys.groupBy("part", "lot").applyInPandas(_merged_lot, merged), "lm-keys")
    tops = (
        lots.groupBy("part")
        .applyInPandas(_tops, "node int, zeros double, ones double, product double")
        .groupBy("node")
        .agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "product")))
        .toPandas()
    )  # at most 65,536 nodes
    upper = upper_levels(tops["node"].to_numpy(np.int64), *(tops[c].to_numpy(float) for c in ("zeros", "ones", "product")))

    reply = "block long, kind string, part int, value binary"
    known = lots.groupBy("part").applyInPandas(lambda p: _lot_probabilities(p, upper), "part int, lot int, first binary, logs binary")
    counted = word_lots.groupBy("part").applyInPandas(_lot_counts, merged)
    replies = words.groupBy("part", "lot").cogroup(counted.groupBy("part", "lot")).applyInPandas(_count_replies, reply).unionByName(
        keys.groupBy("part", "lot").cogroup(known.groupBy("part", "lot")).applyInPandas(_probability_replies, reply)
    )
    return (
        texts.groupBy("block").cogroup(replies.groupBy("block"))
        .applyInPandas(lambda d, r: _documents(d, r, tokens, distinct, n), RESULT)
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_corpus(docs, crc_mod(F.col("doc_id"), 7) == 2)
