from __future__ import annotations

import hashlib

import cases
import corpus_pipeline
import numpy as np
import pytest

from riskloom.llm import quality, toxicity
from riskloom.llm.bpe import public_tokenizer
from riskloom.llm.decontam import WINDOW, Benchmark, cut_spans, is_contaminated
from riskloom.sources.storage import materialise


def test_stages_against_plain_versions(spark, sf):
    from test_simhash import plain_components, plain_fingerprint

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "decontamination", "byte_pair_encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame = docs

    def step(name):
        nonlocal frame
        frame = materialise(stages[name](spark, frame, sf), name)
        assert name == "byte_pair_encoding" or frame.columns == docs.columns
        return sorted(r["doc_id"] for r in frame.collect())

    trees = quality.fit_tables(spark, sf, frame)
    good = [i for i in texts if trees.probability(np.array([quality.statistics(texts[i].encode())]))[0] >= 0.7]
    assert step("quality") == sorted(good)
    model = toxicity.fit_tables(spark, sf, frame)
    kind = [i for i in good if model.judge(texts[i].encode())[0] < 0.7]
    assert step("toxicity") == sorted(kind)
    roots = plain_components({i: plain_fingerprint(texts[i].encode()) for i in kind})
    assert step("near_duplicates") == sorted(set(roots.values()))
    known = Benchmark([(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    clean = [i for i in set(roots.values()) if not is_contaminated(*known.hits(texts[i].encode())[:2])]
    assert step("decontamination") == sorted(clean)
    after = {}
    for i in clean:
        _, spans, _ = known.hits(texts[i].encode())
        after[i] = cut_spans(texts[i].encode(), [s for s in spans if s[1] - s[0] >= WINDOW]).decode()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.collect()} == {i: (t, len(t)) for i, t in after.items()}
    assert step("byte_pair_encoding") == sorted(clean)
    encoder = public_tokenizer().encoder()
    texts = after
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(clean)
    for i, r in got.items():
        assert r["ids"] == encoder.encode(texts[i]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, encoder.encode(texts[i]))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, tmp_path, name, stage):
    """Nulls, empty and very long texts, repeats, clashing columns, one label only, no labels, no items, no rows."""
    docs = cases.documents(spark)
    rows = [tuple(r) for r in docs.collect()]
    tables = {
        "labels": [(i, 1, i % 2) for i in (1, 2, 4, 5, 6, 7, 8, 9)], "ones": [(5, 1, 1)], "none": [],
    }
    for k, marks in tables.items():
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        items = [(1, "the cat sat"), (None, None), (2, "")] if marks else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        out = stage(spark, docs, f"{tmp_path}/{k}")
        got = [tuple(r) for r in out.collect()]
        if name == "byte_pair_encoding":
            assert len(got) == len(rows) and out.columns[:2] == ["doc_id", "ids"]
        else:
            assert out.schema.names == docs.schema.names and len(got) <= len(rows)
            assert {r[0] for r in got} <= {r[0] for r in rows}
        assert stage(spark, cases.empty(spark), f"{tmp_path}/{k}").count() == 0
