from __future__ import annotations

import hashlib

import cases
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.decontam import WINDOW, Benchmark, cut_spans, is_contaminated, matches, op9_decontamination, read_parts, remove_spans, without_contaminated, words_of


def brute(text, items, window=WINDOW):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return len(words), len(hit), names


SMALL = st.lists(st.sampled_from([b"a", b"B", b"c", b"zz"]), max_size=14).map(b" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SMALL, max_size=4), SMALL, st.integers(1, 5))
def test_all_occurrences(items, text, window):
    named = [(str(i), x) for i, x in enumerate(items)]
    n, spans, names = Benchmark(named, window).hits(text)
    assert (n, sum(b - a for a, b in spans), names) == brute(text, named, window)
    assert all(a[1] < b[0] or a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_query(spark, sf):
    items = [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in op9_decontamination(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 1 or n_chars < 800").collect()
    known = Benchmark(items)
    for r in docs:
        n, spans, names = known.hits(r["text"].encode())
        own = got[r["doc_id"]]
        hit = sum(b - a for a, b in spans)
        assert (own["n_words"], own["n_hit"], own["n_items"]) == (n, hit, len(names))
        assert own["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert own["contaminated"] == (hit > 0 and 20 * hit >= n)
        if len(r["text"]) < 1500:
            assert (n, hit, names) == brute(r["text"].encode(), items)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "x"), (None, "on the mat", "x"), (2, None, "x"), (3, "  ", "x")], "item_id long, text string, spans string")
    rows = matches(cases.documents(spark), read_parts(items)).collect()
    assert len(rows) == len(cases.TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert [tuple(s) for s in by[6]["spans"]] == [(0, 2), (3, 6)] and by[6]["items"] == ["", "1"]
    assert by[1]["n_words"] == by[2]["n_words"] == 0 and by[9]["items"] == []
    assert matches(cases.empty(spark), read_parts(items)).count() == 0
    none = read_parts(items.limit(0))
    assert all(not r["items"] for r in matches(cases.documents(spark), none).collect())


def test_spans_go(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = "Before, " + item.upper().replace(" ", " - ") + "; after " + "and more " * 300
    docs = spark.createDataFrame([(1, text, "a"), (2, item, "b"), (3, None, "c"), (4, "clean", "d")], "doc_id long, text string, extra string")
    known = Benchmark([("1", item.encode())])
    got = {r["doc_id"]: r["text"] for r in remove_spans(docs, known).collect()}
    assert set(got) == {1, 3, 4} and got[3] is None and got[4] == "clean"
    assert got[1] == "Before, ; after " + "and more " * 300
    n, spans, _ = known.hits(text.encode())
    assert not is_contaminated(n, spans) and cut_spans(b"abc", []) == b"abc"


def test_a_benchmark_in_parts_gives_the_same(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(matches(docs, read_parts(items, part_bytes=b)).collect(), key=lambda r: r["doc_id"]) for b in (1 << 20, 3000))
    assert len(list(read_parts(items, part_bytes=3000))) > 2 and one == many and any(r["items"] for r in one)
    kept = [sorted(r["doc_id"] for r in without_contaminated(docs, items, b).collect()) for b in (1 << 20, 3000)]
    assert kept[0] == kept[1] and len(kept[0]) < docs.count()


def in_two_parts(spark):
    """Two items of 13 words that ``part_bytes`` puts in different parts."""
    items = spark.createDataFrame([(n, " ".join(f"{w}{i}" for i in range(13))) for n, w in ((1, "a"), (2, "b"))], "item_id long, text string")
    first, second = (r["text"] for r in items.collect())
    for part_bytes in range(20, 60):
        found = [{bool(p.hits(first.encode())[1]) * 1, bool(p.hits(second.encode())[1]) * 2} - {0} for p in read_parts(items, part_bytes=part_bytes)]
        if {1} in found and {2} in found:
            return items, first, second, part_bytes
    raise AssertionError("no size parts the items")


def test_rows_are_judged_alike_at_all_benchmark_sizes(spark):
    items, first, second, part_bytes = in_two_parts(spark)
    both = f"{first} {'clean ' * 374}{second}"
    rows = [(None, both, 0), (None, f"{first} {'clean ' * 374}", 1), (7, both, 2), (7, "a clean text", 3), (7, None, 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    for size in (1 << 20, part_bytes):
        kept = without_contaminated(docs, items, size)
        assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [1, 3, 4, 5]


def test_spans_go_alike_at_all_benchmark_sizes(spark):
    items, first, second, part_bytes = in_two_parts(spark)
    rows = [(1, f"Before {first}; {'clean ' * 800}{second} after", "x"), (1, f"{first} {'clean ' * 374}{second}", "y"), (None, None, "z"), (2, "clean", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for size in (1 << 20, part_bytes):
        kept = remove_spans(docs, read_parts(items, part_bytes=size))
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, f"Before ; {'clean ' * 800} after", "x"), (None, None, "z"), (2, "clean", "w")], key=str)


def test_an_item_larger_than_a_part_keeps_its_windows(spark):
    long = " ".join(f"v{i}" for i in range(400))
    words = long.split()
    items = spark.createDataFrame([(1, long), (2, "short one here")], "item_id long, text string")
    texts = [" ".join(words[at : at + 13]) for at in range(0, 388, 3)] + [" ".join(words[at : at + 12]) for at in range(0, 388, 50)] + ["a short one here", long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (sorted(matches(docs, read_parts(items, part_bytes=b)).collect(), key=lambda r: r["doc_id"]) for b in (1 << 20, 300))
    assert len(list(read_parts(items, part_bytes=300))) > 3 and one == many
    assert [bool(r["items"]) for r in one] == [True] * 130 + [False] * 8 + [True, True]
