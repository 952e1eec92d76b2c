from __future__ import annotations

from itertools import combinations

import cases
import numpy as np
import xxhash

from riskloom.llm.components import components
from riskloom.llm.simhash import BUDGET, CHOICES, arranged, fingerprint, near_duplicates, one_of_each, op3_simhash, trie_pairs


def plain_fingerprint(text):
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """Smallest reachable id per row, by all pairs of rows."""
    ids = list(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (marks[a] ^ marks[b]).bit_count() <= BUDGET:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    for _, text in cases.TEXTS:
        data = None if text is None else text.encode()
        assert fingerprint(data) == plain_fingerprint(data)


def test_trie_pairs_are_all_close_pairs():
    random = np.random.default_rng(3)
    keys = random.integers(0, 1 << 62, 60, dtype=np.uint64)
    keys = np.unique(np.concatenate([keys, *(keys[:20] ^ np.uint64((1 << a) | (1 << b)) for a, b in ((0, 63), (5, 5), (17, 30), (60, 1)))]))
    want = {(int(a), int(b)) for a, b in combinations(keys, 2) if int(a ^ b).bit_count() <= BUDGET}
    assert {(int(keys[x]), int(keys[y])) for a, b in trie_pairs(keys, 0) for x, y in zip(a, b, strict=True)} == want
    found = set()
    for order, depth in CHOICES:
        shown = arranged(keys, order)
        by = np.argsort(shown)
        found |= {tuple(sorted((int(keys[by[x]]), int(keys[by[y]])))) for a, b in trie_pairs(shown[by], depth) for x, y in zip(a, b, strict=True)}
    assert found == want and len(want) > 60


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (-7, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(rows, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: -7, 101: -7, -7: -7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {i: plain_fingerprint(t.encode()) for i, t in docs.items()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in op3_simhash(spark, sf).collect()}
    roots = plain_components(marks)
    assert got == {i: (marks[i], roots[i]) for i in docs}


def test_awkward_rows(spark):
    rows = near_duplicates(cases.documents(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[6]] == [6, 6] and by[7][0]["component_id"] == 6
    assert {by[i][0]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and {by[i][0]["component_id"] for i in (1, 2, 3)} == {1}
    assert sorted(str(r["component_id"]) for r in by[None]) == ["1", "6"]
    kept = one_of_each(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [-11, 1, 4, 5, 6, 8, 9, 10]
    assert near_duplicates(cases.empty(spark)).count() == 0 and one_of_each(cases.empty(spark)).count() == 0


def test_rows_without_ids_keep_one_of_each(spark):
    docs = spark.createDataFrame([(None, "alone here is one"), (None, "alone here is one"), (None, "quite another text"), (3, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in one_of_each(docs).collect()) == ["None", "alone here is one", "quite another text"]


def test_one_id_in_two_components_keeps_one_of_each(spark):
    rows = [(3, "the cat sat on the mat"), (5, "THE cat sat on the mat"), (5, "quite another text of its own"), (5, "quite another text of its own"), (6, "a third one stands here")]
    for order in (rows, rows[::-1]):
        kept = one_of_each(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(map(tuple, kept)) == [rows[0], rows[2], rows[4]]


def test_unlike_texts_under_one_id_all_stay(spark):
    a, b, c = "the first text of this id", "one more that differs in all its words", "something else altogether here"
    for rows in ([(5, b, "x"), (5, a, "x"), (3, b, "x")], [(5, a, "x"), (5, b, "x")], [(None, a, "x"), (None, b, "y"), (None, b, "x"), (None, c, None)], [(5, a, "x"), (5, a, "y"), (5, a, "x")]):
        kept = [sorted(map(tuple, one_of_each(spark.createDataFrame(order, "doc_id long, text string, _key string").repartition(n)).collect()), key=str) for order in (rows, rows[::-1]) for n in (1, 3)]
        assert all(k == kept[0] for k in kept) and [r[1] for r in kept[0]] == [r[1] for r in sorted({x[1]: x for x in kept[0]}.values(), key=str)]
        assert {r[1] for r in kept[0]} == {r[1] for r in rows} and set(kept[0]) <= set(rows)
    assert (3, b, "x") in [tuple(r) for r in one_of_each(spark.createDataFrame([(5, b, "x"), (5, a, "x"), (3, b, "x")], "doc_id long, text string, _key string")).collect()]
