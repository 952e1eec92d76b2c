from __future__ import annotations

import cases
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.bpe import SPACE_LED, PrefixTable, Vocabulary, decode_documents, encode_documents, op2_bpe, public_tokenizer, round_trips

FILE = public_tokenizer()
ENCODER = FILE.encoder()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.vocabulary.ranks, special_tokens={})
TEXT = st.text(st.sampled_from(list("ab e  \n\té'st漢🙂.1\u00a0")) | st.characters(codec="utf-8"), max_size=60)


def test_pattern():
    assert public_tokenizers.PATTERN == SPACE_LED


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and ENCODER.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.binary(max_size=8), st.binary(max_size=8))
def test_append_and_edit(data, a, b, new, more):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    table = PrefixTable(ENCODER.vocabulary, data)
    table.edit(a, b, new)
    table.append(more)
    assert table.data == data[:a] + new + data[b:] + more
    assert table.ids() == ENCODER.vocabulary.merged(table.data)


def test_an_edit_computes_little():
    data = b"the quick brown fox jumps over the lazy dog " * 200
    table = PrefixTable(ENCODER.vocabulary, data)
    assert table.edit(4000, 4005, b"crown") < 1000
    assert table.ids() == PrefixTable(ENCODER.vocabulary, table.data).ids()


def test_tokens_that_merges_never_give():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"cd": 257, b"bc": 258, b"abcd": 259, b"bcd": 260}
    v = Vocabulary(ranks)
    for text in (b"abcd", b"bcd", b"abc", b"bcdab", b"aabbccdd", b"abcdabcd"):
        assert PrefixTable(v, text).ids() == v.merged(text)


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = encode_documents(docs, FILE).collect()
    want = sorted((LIBRARY.encode_ordinary(t or "") for _, t in cases.TEXTS))
    assert sorted(list(r["ids"]) for r in rows) == want
    back = decode_documents(encode_documents(docs, FILE), FILE).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for _, t in cases.TEXTS)
    assert round_trips(cases.empty(spark), FILE).count() == 0


def test_query(spark, sf):
    import hashlib

    got = {r["doc_id"]: r for r in op2_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r["text"])
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_unknown_byte():
    with pytest.raises(ValueError, match="not in the vocabulary"):
        PrefixTable(Vocabulary({b"a": 0}), b"b")
