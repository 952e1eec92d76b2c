"""Chat formatting by token-level assembly.

Every turn is encoded on its own, so no token crosses a border, and reserved
ids, which the encoder never gives, stand for the control strings around it.
Control strings that occur in a text get a backslash (one more, if there are
some already), so the written form can be read back too.  The loss mask is
the running sum of +1 where an assistant text starts and -1 where it ends.

Turns are dealt by ranges of (conversation, turn, role, text), so a
conversation with a third of all rows spreads over many tasks, and stream
through in order, in chunks of ``CHUNK_TURNS`` turns or ``CHUNK_BYTES``.  Only
the digest of a conversation that several chunks hold is made in one task,
which reads its chunks one by one, as a hash must.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import TokenizerFile, as_text, public_tokenizer
from riskloom.llm.common import partitions, table
from riskloom.sources.storage import materialise

CHUNK_TURNS = 512
CHUNK_BYTES = 4 << 20
#: Characters of a role and a text that the ranges are cut by.
RANGE_CHARS = 64

#: The control strings, whose ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, TEXT, ROLE_END = range(len(CONTROLS))
#: What stands before and after the text of a role; another role is written out.
FRAMES = {"user": (USER, USER_END), "assistant": (BEGIN, END), "system": (SYSTEM, SYSTEM_END)}

_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\*(?:{_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")


def escape(text: str) -> str:
    """Puts a backslash before each control string and the backslashes before it."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Assembles and reads back turns as token ids with reserved ids."""

    def __init__(self, tokenizer: TokenizerFile):
        self.encoder = tokenizer.encoder()
        self.first = self.encoder.vocabulary.base - 1

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The ids of a turn, and where its text starts and ends in them."""
        before, after = FRAMES.get(role, (None, None))
        if before is None:
            head = [self.first + ROLE, *self.encoder.encode(escape(role)), self.first + TEXT]
            after = ROLE_END
        else:
            head = [self.first + before]
        ids = head + self.encoder.encode(escape(text))
        return [*ids, self.first + after], len(head), len(ids)

    def read(self, ids: np.ndarray) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, where the text starts, and ends) of each turn."""
        at = np.flatnonzero(ids >= self.first)
        marks = (ids[at] - self.first).tolist()
        roles = {before: role for role, (before, _) in FRAMES.items()}
        i = 0
        while i < len(at):
            if marks[i] == ROLE:
                role = unescape(self.encoder.decode(ids[at[i] + 1 : at[i + 1]].tolist()).decode())
                i += 1
            else:
                role = roles[marks[i]]
            start, end = int(at[i]) + 1, int(at[i + 1])
            yield role, unescape(self.encoder.decode(ids[start:end].tolist()).decode()), start, end
            i += 2

    def written(self, ids: np.ndarray) -> str:
        """The formatted text, with reserved ids as their control strings."""
        out, last = [], 0
        for i in np.flatnonzero(ids >= self.first).tolist():
            out += [self.encoder.decode(ids[last:i].tolist()).decode(), CONTROLS[ids[i] - self.first]]
            last = i + 1
        return "".join(out)


def assemble(turns: list[tuple[list[int], int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of encoded turns (ids, start and end of the text, learned)."""
    parts = [np.array(ids, np.int32) for ids, *_ in turns]
    starts = np.cumsum([0, *map(len, parts)])
    change = np.zeros(starts[-1] + 1, np.int8)
    for offset, (_, a, b, learned) in zip(starts[:-1], turns, strict=True):
        if learned and b > a:
            change[offset + a] += 1
            change[offset + b] -= 1
    return np.concatenate(parts), np.cumsum(change[:-1], dtype=np.int8)


def _ordered(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(conv_id, role, text) dealt by ranges and sorted by conversation, turn, role and text."""
    chosen = rows.select(
        F.col(columns["conv_id"]).cast("long").alias("conv_id"), F.col(columns["turn"]).cast("long").alias("turn"),
        F.coalesce(F.col(columns["role"]).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(columns["text"]).cast("string"), F.lit("")).alias("text"),
    )
    # The driver sees a sample of the range keys, so they must be short; cut texts keep their order.
    role = F.substring("role", 1, RANGE_CHARS)
    text = F.when(F.length("role") < RANGE_CHARS, F.substring("text", 1, RANGE_CHARS)).otherwise("")
    dealt = chosen.repartitionByRange(partitions(rows.sparkSession), F.col("conv_id"), F.col("turn"), role, text)
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary"))


def _chunks(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[int | None, bool, list]]:
    """(conversation, whole, encoded turns) from sorted rows.  ``whole``: the
    chunk holds all turns of the conversation, as others stand before and after it."""
    current, cut, turns, held, seen = None, True, [], 0, False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for conv, role, text in zip(*columns, strict=True):
            if seen and conv != current:
                yield current, not cut, turns
                cut, turns, held = False, [], 0
            elif len(turns) >= CHUNK_TURNS or held >= CHUNK_BYTES:
                yield current, False, turns
                cut, turns, held = True, [], 0
            current, seen = conv, True
            said = as_text(role)
            turns.append((*template.turn(said, as_text(text)), said == "assistant"))
            held += len(text)
    if seen:
        yield current, False, turns


def _first_chunk() -> int:
    """Chunks are numbered upwards from here in the running task, in the order of the ranges."""
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << 32


_COLUMNS = {c: c for c in ("conv_id", "turn", "role", "text")}


def format_conversations(rows: DataFrame, tokenizer: TokenizerFile, **columns: str) -> DataFrame:
    """One row per chunk of a conversation: conv_id, chunk, ids and loss_mask
    (arrays of one length) and the written text.  ``chunk`` grows along a
    conversation, not always by one.

    Turns stand by turn number (null first), then role, then text, so ties and
    repeated rows keep a fixed place; a null conversation id is one more
    conversation; null roles and texts are empty; other columns are ignored;
    no rows give no rows.  ``columns`` renames conv_id, turn, role or text.
    """
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(sent.value)
        for chunk, (conv, _, turns) in enumerate(_chunks(batches, template), _first_chunk()):
            ids, mask = assemble(turns)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8())), pa.array([template.written(ids)])],
                names=["conv_id", "chunk", "ids", "loss_mask", "formatted"],
            )

    return _ordered(rows, _COLUMNS | columns).mapInArrow(run, "conv_id long, chunk long, ids array<int>, loss_mask array<byte>, formatted string")


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
_DIGESTS_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: A chunk of a conversation that others share has a number and its texts in place of digests.
_PIECES = pa.schema([*_DIGESTS, ("chunk", pa.int64()), ("said", pa.binary()), ("learned", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _whole_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its chunks, sorted by number."""
    current, sums, hashes, seen = None, [0, 0, 0], (), False

    def row() -> pa.RecordBatch:
        n, learned, written = sums
        return _batch([(current, n, hashes[0].hexdigest(), learned, hashes[1].hexdigest(), written)], _DIGESTS)

    for batch in batches:
        for r in batch.to_pylist():
            if not seen or r["conv_id"] != current:
                if seen:
                    yield row()
                current, sums, hashes, seen = r["conv_id"], [0, 0, 0], (hashlib.sha256(), hashlib.sha256()), True
            sums = [a + r[c] for a, c in zip(sums, ("n_turns", "loss_chars", "formatted_chars"), strict=True)]
            hashes[0].update(r["said"])
            hashes[1].update(r["learned"])
    if seen:
        yield row()


def formatted_digests(rows: DataFrame, tokenizer: TokenizerFile, **columns: str) -> DataFrame:
    """Formats like ``format_conversations`` and reads the result back: one row
    per conversation with its turns' and its learned texts' digests.  Cases as there."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(sent.value)
        out, held = [], 0
        for chunk, (conv, whole, turns) in enumerate(_chunks(batches, template), _first_chunk()):
            ids, mask = assemble(turns)
            back = list(template.read(ids))
            said = "".join(f"{role}\n{text}\n" for role, text, _, _ in back).encode()
            learned = "".join(text for _, text, a, b in back if b > a and mask[a:b].all())
            counts, data = (len(back), len(learned), len(template.written(ids))), learned.encode()
            if whole:
                out.append((conv, counts[0], hashlib.sha256(said).hexdigest(), counts[1], hashlib.sha256(data).hexdigest(), counts[2], None, None, None))
            else:
                out.append((conv, counts[0], None, counts[1], None, counts[2], chunk, said, data))
                held += len(said)
            if len(out) >= 1000 or held >= CHUNK_BYTES:
                yield _batch(out, _PIECES)
                out, held = [], 0
        if out:
            yield _batch(out, _PIECES)

    found = materialise(_ordered(rows, _COLUMNS | columns).mapInArrow(run, _DIGESTS_SQL + ", chunk long, said binary, learned binary"), "conversations")
    names = _DIGESTS.names
    pieces = found.where(F.col("chunk").isNotNull()).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return found.where(F.col("chunk").isNull()).select(names).unionByName(pieces.mapInArrow(_whole_digests, _DIGESTS_SQL))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return formatted_digests(rows.unionByName(more), public_tokenizer())
