from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.bpe import public_tokenizer
from riskloom.llm.chat import CHUNK_TURNS, CONTROLS, Template, assemble, escape, format_conversations, formatted_digests, op5_chat, unescape

FILE = public_tokenizer()
PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "s>", " ", "ok", "é", "\n", "</"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool<s>", ""]), PIECES), min_size=1, max_size=5))
def test_turns_read_back(turns):
    template = Template(FILE)
    ids, mask = assemble([(*template.turn(role, text), role == "assistant") for role, text in turns])
    back = list(template.read(ids))
    assert [(r, t) for r, t, _, _ in back] == turns
    learned = np.zeros(len(ids), bool)
    for role, _, a, b in back:
        learned[a:b] = role == "assistant"
    assert (mask.astype(bool) == learned).all()


def digests(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_awkward_rows(spark):
    long = [(4, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(2 * CHUNK_TURNS + 3)]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "w " * 30_000), *long]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, ids string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in formatted_digests(df, FILE).collect()}
    assert got[1] == digests([("user", "a"), ("assistant", "b"), ("assistant", "b")])
    assert got[2] == digests([(None, None)]) and got[None] == digests([("user", "x")])
    assert got[3][2] == 60_000 and got[4] == digests([r[2:] for r in long])
    out = format_conversations(df, FILE).collect()
    assert all(len(r["ids"]) == len(r["loss_mask"]) for r in out) and sum(r["conv_id"] == 4 for r in out) >= 3
    written = "".join(r["formatted"] for r in sorted(out, key=lambda r: r["chunk"]) if r["conv_id"] == 4)
    assert written == "".join(f"[INST]{t}[/INST]" if role == "user" else f"<s>{t}</s>" for _, _, role, t in long)
    assert formatted_digests(df.limit(0), FILE).count() == 0


def test_query(spark, sf):
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    rows = op5_chat(spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == {k: digests(v) for k, v in turns.items()}
    assert all(r["formatted_chars"] > sum(len(t) for _, t in turns[r["conv_id"]]) for r in rows)


def test_ties_stand_by_role_and_text(spark):
    """Not by the ids of their tokens; long roles and texts too, in any dealing."""
    words = ["a", "b", "the", "zebra crossing", "\u00e9", "Z", "", "x" * 100 + "b", "x" * 100 + "a", "x" * 64]
    roles = ["user", "assistant", "r" * 64, "r" * 63, "r" * 70 + "b", "r" * 70 + "a"]
    rows = [(conv, turn, r, w) for conv in (1, None) for turn in (0, None) for r in roles for w in words]
    order = {c: sorted((x[1:] for x in rows if x[0] == c), key=lambda x: (x[0] is not None, x[1].encode(), x[2].encode())) for c in (1, None)}
    for dealt in (rows, rows[::-1]):
        got = {r["conv_id"]: tuple(r)[1:5] for r in formatted_digests(spark.createDataFrame(dealt, "conv_id long, turn long, role string, text string"), FILE).collect()}
        assert got == {c: digests([(r, t) for _, r, t in x]) for c, x in order.items()}


def test_one_conversation_of_many_turns_spreads(spark):
    from pyspark.sql import functions as F

    rows = [(7 if i % 3 == 0 else i, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = format_conversations(df, FILE).where("conv_id = 7").select((F.col("chunk") / (1 << 32)).cast("int").alias("task"))
    assert out.distinct().count() > 1
    got = {r["conv_id"]: tuple(r)[1:5] for r in formatted_digests(df, FILE).collect()}
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    assert got == {c: digests(t) for c, t in want.items()}
