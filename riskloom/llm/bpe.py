"""Byte-level BPE by prefix dynamic programming.

Of any byte string exactly one tokenisation is what the merges give, and all
its prefixes share one table: entry i is the last token of the encoding of
the first i bytes.  The entry is the one token that ends at i and may follow
the entry at its own start; two tokens may be neighbours if merging their
joined bytes gives them back.  A table grows by appending without any change
to earlier entries, and after an edit only the entries near it are computed
again, until the old and the new table agree over the longest token's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from riskloom.llm.common import table

CACHED_PIECES = 300_000
CACHED_PREFIXES = 600_000
CACHED_LENGTH = 48
CHUNKS_AT_ONCE = 65_536

#: A fixed value: the split pattern that the rank files are made for.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_GAP = re.compile(r"\s |\ \s|^\s|\s$")
_NARROW_GAP = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Ranked byte tokens, with the neighbour relation that the merges imply."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.longest = max(map(len, ranks))
        self.base = max(self.bytes_of) + 2
        self.ends: dict[bytes, int] = {}
        for token in ranks:
            for i in range(1, len(token)):
                self.ends.setdefault(token[i:], -1)
        self.ends.update(ranks)
        self._spines: dict[int, tuple[list[int], list[int]] | None] = {}
        self._neighbours: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges carried out plainly, lowest rank first; slow, for short strings."""
        return [self.ranks[p[0]] for p in self._merge(data)]

    def _merge(self, data: bytes) -> list[tuple]:
        """Parts as (bytes, the tokens at its left edge, at its right edge), from small to large."""
        parts = [(c, [self.ranks[c]], [self.ranks[c]]) for c in (data[i : i + 1] for i in range(len(data)))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a[0] + b[0], self.base), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.base:
                break
            a, b = parts[at : at + 2]
            parts[at : at + 2] = [(a[0] + b[0], a[1] + [rank], b[2] + [rank])]
        return parts

    def _edges(self, token: int) -> tuple[list[int], list[int]] | None:
        """The tokens that grow at both edges of a token; None if merges never give it."""
        if token not in self._spines:
            parts = self._merge(self.bytes_of[token])
            self._spines[token] = parts[0][1:] if len(parts) == 1 else None
        return self._spines[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` can come right after ``before`` (-1: at the start).

        While the two grow from single bytes by merges of rising rank, no merge
        across their border may come before the next merge at either side.
        """
        known = self._neighbours.get(before * self.base + token)
        if known is None:
            if len(self._neighbours) > 1_000_000:
                self._neighbours.clear()
            known = self._border_holds(before, token)
            self._neighbours[before * self.base + token] = known
        return known

    def _border_holds(self, before: int, token: int) -> bool:
        right = self._edges(token)
        if before < 0 or right is None:
            return right is not None
        left = self._edges(before)
        if left is None:
            return False
        a, b = left[1], right[0]
        if a != sorted(a) or b != sorted(b):
            return self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        i = j = 0
        while True:
            cross = self.ranks.get(self.bytes_of[a[i]] + self.bytes_of[b[j]], self.base)
            next_a = a[i + 1] if i + 1 < len(a) else self.base
            next_b = b[j + 1] if j + 1 < len(b) else self.base
            if cross < next_a and cross <= next_b and cross < self.base:
                return False
            if next_a == next_b == self.base:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _entry(self, i: int) -> int:
        vocabulary, data, last = self.vocabulary, self.data, self.last
        ends, known, base = vocabulary.ends, vocabulary._neighbours, vocabulary.base
        for j in range(i - 1, -1, -1):
            token = ends.get(data[j:i])
            if token is None:
                break
            if token >= 0:
                follows = known.get(last[j] * base + token)
                if follows or follows is None and vocabulary.may_follow(last[j], token):
                    return token
        raise ValueError("a byte is not in the vocabulary")

    def append(self, data: bytes) -> None:
        start, self.data = len(self.data), self.data + data
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(i))

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many entries were computed."""
        after = self.last[end + 1 :]
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start + 1 :]
        same = done = 0
        first_old = start + len(data) + 1
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(token := self._entry(i))
            done += 1
            if i >= first_old:
                same = same + 1 if after[i - first_old] == token else 0
                if same >= self.vocabulary.longest:
                    self.last += after[i - first_old + 1 :]
                    break
        return done

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(token := self.last[i])
            i -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; pieces that are tokens stand as they are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.space_led = pattern == SPACE_LED
        self._known: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._last: dict[bytes, int] = {b"": -1}
        self.names = {i: str(i) for i in self.vocabulary.bytes_of}

    def _short(self, data: bytes) -> tuple[int, ...]:
        """As ``PrefixTable``, with one table for the prefixes of all pieces,
        where only the prefixes that a token's start asks for are entered."""
        vocabulary, last = self.vocabulary, self._last
        ranks, known, base = vocabulary.ranks, vocabulary._neighbours, vocabulary.base
        waiting: list[tuple[bytes, int]] = []  # a prefix and the start of the token that needs a shorter one first
        prefix, j = data, max(len(data) - vocabulary.longest, 0)
        while prefix not in last:
            # The one that fits is most often the longest token at the end.
            token = ranks.get(prefix[j:])
            if token is None:
                j += 1
            elif (before := last.get(prefix[:j])) is None:
                waiting.append((prefix, j))
                prefix, j = prefix[:j], max(j - vocabulary.longest, 0)
            else:
                follows = known.get(before * base + token)
                if follows or follows is None and vocabulary.may_follow(before, token):
                    last[prefix] = token
                    if waiting:
                        prefix, j = waiting.pop()
                else:
                    j += 1
            if j >= len(prefix):
                raise ValueError("a byte is not in the vocabulary")
        out, n = [], len(data)
        while n:
            out.append(token := last[data[:n]])
            n -= len(vocabulary.bytes_of[token])
        if len(last) > CACHED_PREFIXES:
            self._last = {b"": -1}
        return tuple(reversed(out))

    def _ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        if token is not None:
            return (token,)
        if len(data) > CACHED_LENGTH:
            return tuple(PrefixTable(self.vocabulary, data).ids())
        return self._short(data)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that is not in ``_known``; one led by a space may stand among the chunks."""
        ids = (piece[0] == " " and self._chunks.get(piece[1:])) or self._ids(piece)
        if len(self._known) >= CACHED_PIECES:
            self._known.clear()
        self._known[piece] = ids
        return ids

    def _encode_pieces(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._known.get
        for piece in self.pieces(text):
            out += known(piece) or self._piece(piece)
        return out

    def _chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a chunk with its space; one that is a piece is not kept among the pieces too."""
        pieces = self.pieces(text)
        known = self._known.get
        if len(pieces) == 1:
            return known(text) or self._ids(text)
        return tuple(chain.from_iterable([known(piece) or self._piece(piece) for piece in pieces]))

    def _add_chunks(self, chunks: list[str], out: list[int]) -> None:
        """Adds the ids of chunks that each follow a space: each different one is encoded once, then all are looked up."""
        known = self._chunks
        new = set(chunks).difference(known)
        if len(known) + len(new) > CACHED_PIECES:
            known.clear()
            new = set(chunks)
        for chunk in new:
            known[chunk] = self._chunk(" " + chunk)
        out.extend(chain.from_iterable(map(known.__getitem__, chunks)))
        for chunk in new:
            if len(chunk) > CACHED_LENGTH:
                del known[chunk]

    def encode(self, text: str) -> list[int]:
        """The ids of a text.

        A single space between other characters starts a piece under the usual
        pattern, so what stands between such spaces is looked up as a whole.
        """
        if not self.space_led:
            return self._encode_pieces(text)
        chunks = _NARROW_GAP.split(text) if _WIDE_GAP.search(text) else text.split(" ")
        out = self._encode_pieces(chunks[0])
        for at in range(1, len(chunks), CHUNKS_AT_ONCE):
            self._add_chunks(chunks[at : at + CHUNKS_AT_ONCE], out)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class TokenizerFile:
    """A rank file and its pattern, as sent to the executors (under one MB)."""

    _encoders: dict[bytes, Encoder] = {}

    def __init__(self, content: bytes, pattern: str):
        self.content, self.pattern = content, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> TokenizerFile:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def encoder(self) -> Encoder:
        """One encoder for each worker process."""
        key = hashlib.sha256(self.pattern.encode() + b"\0" + self.content).digest()
        if key not in self._encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
            self._encoders[key] = Encoder(ranks, self.pattern)
        return self._encoders[key]


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> TokenizerFile:
    import public_tokenizers

    return TokenizerFile.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def as_text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def _mapped(docs: DataFrame, tokenizer: TokenizerFile, id_col: str, text_col: str, columns: dict[str, pa.DataType], values: Callable[[Encoder, str], tuple]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, from_arrow_type(t)) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                out = [values(encoder, as_text(t)) for t in texts.slice(at, 256).to_pylist()]
                done = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *done], names=["doc_id", *columns])

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: TokenizerFile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids, the tokens of the whole text.

    A null or empty text has no tokens; null ids and repeated rows stay; other
    columns are ignored; no rows give no rows; bytes that are not UTF-8 count
    as U+FFFD.  A narrow map: nothing is shuffled.
    """
    return _mapped(docs, tokenizer, id_col, text_col, {"ids": pa.list_(pa.int32())}, lambda e, t: (e.encode(t),))


def decode_documents(encoded: DataFrame, tokenizer: TokenizerFile, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids (null ids: none)."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder()
        for batch in batches:
            data = [encoder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, data binary")


def _digests(encoder: Encoder, text: str) -> tuple[int, str, str]:
    return _encoded_digests(encoder, text)[1:]


def round_trips(docs: DataFrame, tokenizer: TokenizerFile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens and the
    SHA-256 of the ids (decimal, comma-joined) and of the decoded bytes.
    Cases as in ``encode_documents``."""
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(docs, tokenizer, id_col, text_col, columns, _digests)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizer())


def _encoded_digests(encoder: Encoder, text: str) -> tuple[list[int], int, str, str]:
    ids = encoder.encode(text)
    listed = ",".join(map(encoder.names.__getitem__, ids))
    return ids, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as tokens: doc_id, ids, and n_tokens and digests as in ``round_trips``; cases as in ``encode_documents``."""
    columns = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(docs, public_tokenizer(), "doc_id", "text", columns, _encoded_digests)
