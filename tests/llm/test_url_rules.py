from __future__ import annotations

import random
import time
from collections import Counter
from itertools import chain, combinations, product

import pytest
from pyspark.sql import functions as F

from riskloom.llm.url_rules import MIN_CONFIDENCE, MIN_LIFT, MIN_ROWS, RULES, judge_urls, op4_url_filters


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def listed(host, path):
    best = None
    for verdict, rule in RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


URLS = [
    None, "", "no scheme/x", "https://Example.ORG/es/1", "http://a.example.org/en/12?x=1", "http://example.org", "http://x.com/fr/?a", "http://x.com/de/#t",
    "http://notorg/x", "ftp://org/", "http://u@h.com:80/de/", "x://y://z/de", "http://ÄB.COM/fr/é", "http://?q", "HTTP://X.ORG?p/q#r", "https://a.com/fr/\nq",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in enumerate(URLS)] + [(None, URLS[3], "h", "r", 1.0), (3, URLS[3], "h", "r", 1.0)], "page_id long, url string, host string, rule string, found double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = judge_urls(pages, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r["page_id"] is None:
            continue
        host, path = split(URLS[r["page_id"]])
        rule = listed(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule[1], rule[0] if rule else "allow")
    assert judge_urls(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        site = "casino" if bad and i % 8 else "plain"
        rows.append((i, f"https://{site}.test/p/{i}?ref={i % 3}"))
        marks.append((i, 0 if bad else 1, None))
    rows += [(1000, "https://casino.test/p/77?ref=x"), (1001, "https://plain.test/p/1"), (1002, "https://casino.test.org/p/9")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert got[1000]["verdict"] == "block" and got[1000]["mined_confidence"] == pytest.approx(1.0)
    assert got[1001]["verdict"] == "allow" and got[1002]["verdict"] == "allow"


def test_a_bad_host_below_one_percent(spark):
    """MIN_ROWS bad rows are enough, one less is not, among 4,000 rows."""
    sites = ["casino"] * MIN_ROWS + ["rarely"] * (MIN_ROWS - 1)
    rows = [(i, f"https://{sites[i] if i < len(sites) else 'plain'}.test/p/{i}") for i in range(4000)]
    marks = [(i, int(i >= len(sites)), None) for i, _ in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert got[0]["verdict"] == "block" and got[0]["mined_confidence"] == pytest.approx(1.0)
    assert got[MIN_ROWS]["verdict"] == "allow" and got[3999]["verdict"] == "allow"


def all_rules(taught, min_rows=MIN_ROWS):
    """Every set of tokens that is a rule, by counting all subsets of all rows' frequent tokens."""
    share = sum(bad for _, bad in taught) / len(taught)
    often = {t for t, n in Counter(t for tokens, bad in taught if bad for t in tokens).items() if n >= min_rows}
    rows, bad_rows = Counter(), Counter()
    for tokens, bad in taught:
        own = sorted(tokens & often)
        assert len(own) <= 14
        for size in range(1, len(own) + 1):
            for x in combinations(own, size):
                rows[x] += 1
                bad_rows[x] += bad
    return {frozenset(x) for x, n in bad_rows.items() if n >= min_rows and n / rows[x] >= MIN_CONFIDENCE and n / rows[x] >= MIN_LIFT * share}


def assert_verdicts(rows, tokens, taught):
    rules = all_rules(taught)
    for r in rows:
        rule = listed(r["host"], r["path"])
        blocked = any(x <= tokens[r["page_id"]] for x in rules)
        assert r["verdict"] == (rule[0] if rule else "block" if blocked else "allow") and bool(r["mined_rule"]) == blocked
        if blocked:
            own = set(r["mined_rule"].split(" "))
            assert own in rules and own <= tokens[r["page_id"]]
            held = [bad for t, bad in taught if own <= t]
            assert r["mined_confidence"] == pytest.approx(sum(held) / len(held))
    return rules


def judged(spark, pages, labels):
    from riskloom.llm.url_rules import host_and_path, url_tokens

    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_tokens(F.col("url"), *host_and_path(F.col("url"))).alias("t")).collect()}
    bad = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in labels.collect()}
    return judge_urls(pages, labels).collect(), tokens, [(tokens[i], bad[i]) for i in tokens if i in bad]


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_query_against_all_itemsets(spark, sf, scale):
    sf = sf.replace("sf0.001", scale)
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    rows, tokens, taught = judged(spark, pages, labels)
    assert len(rows) == pages.count()
    assert_verdicts(rows, tokens, taught)
    assert Counter(r["verdict"] for r in op4_url_filters(spark, sf).collect()) == Counter(r["verdict"] for r in rows)


def test_sets_of_tokens_against_all_itemsets(spark):
    """Labels hang on pairs and triples of tokens, some of which always come together."""
    rng = random.Random(2)
    for seed in range(3):
        urls, marks = [], []
        for i in range(1500):
            site, kind, key = rng.choice("abc"), rng.choice("pqrs"), rng.choice(["x", "y", "z"])
            urls.append((i, f"https://{site}.{site}host.test/{kind}/{kind}sub/{rng.choice('uvw')}?{key}=1"))
            odd = (site == "a" and kind == "p") or (kind == "q" and key == "y" and site != "c")
            marks.append((i, int(rng.random() > (0.9 if odd else 0.1)), rng.choice([None, 0])))
        urls += [(2000 + j, f"https://{a}.{b}host.test/{k}/other/u?{q}=1") for j, (a, b, k, q) in enumerate(product("abc", "abc", "pq", "xy"))]
        pages = spark.createDataFrame(urls, "page_id long, url string")
        rules = assert_verdicts(*judged(spark, pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
        assert max(map(len, rules)) > 2 and not any(len(x) == 1 for x in rules)


def test_one_deep_path_ends_soon(spark):
    """Thirty path parts that always come together, or nested paths of every
    depth, bad now and then: FP-growth alone would find two to the power of thirty sets."""
    rng = random.Random(1)
    deep, nest = "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30)), [f"n{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30)]
    rows = [(i, f"https://plain.test/p/{i}") for i in range(4000)] + [(4000 + i, f"https://deep.test/{deep}/{i}") for i in range(80)]
    rows += [(5000 + i, f"https://nest.test/{'/'.join(nest[: 1 + i % 30])}") for i in range(3000)]
    marks = [(i, int(rng.random() > (0.1 if i < 4000 else 0.45)), 0) for i, _ in rows]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    began = time.perf_counter()
    got = judge_urls(pages, labels).collect()
    assert len(got) == len(rows) and time.perf_counter() - began < 60


@pytest.mark.parametrize("most", [1, 2, 3])
def test_rows_with_more_classes_than_are_shown(spark, monkeypatch, most):
    """Rows of four or five undecided classes, of which FP-growth sees fewer; rules are those of all subsets."""
    from riskloom.llm import url_rules

    monkeypatch.setattr(url_rules, "MOST", most)
    rng = random.Random(5)
    urls, marks = [], []
    for i in range(1500):
        site, kind, key, end = rng.choice("abc"), rng.choice("pqrs"), rng.choice(["x", "y", "z"]), rng.choice(["", "", "&w=2"])
        urls.append((i, f"https://{site}.{site}host.test/{kind}/{kind}sub/{rng.choice('uvw')}?{key}=1{end}"))
        odd = (site == "a" and kind == "p") or (kind == "q" and key == "y" and site != "c")
        marks.append((i, int(rng.random() > (0.9 if odd else 0.1)), 0))
    urls += [(2000 + j, f"https://{a}.{b}host.test/{k}/other/u?{q}=1") for j, (a, b, k, q) in enumerate(product("abc", "abc", "pq", "xy"))]
    rules = assert_verdicts(*judged(spark, spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    assert max(map(len, rules)) > 2


def test_a_pair_behind_more_classes_than_are_shown(spark):
    """Two parts, seldom bad but always together, in rows with 16 classes or more of larger bad shares."""
    rng = random.Random(3)
    nest = [f"n{chr(97 + i)}" for i in range(22)]
    rows, marks = [], []
    for i in range(3000):
        kind = ["y", "z", "y/z", "", "", "", "", ""][i % 8] if i < 2400 else ["y", "z", ""][i % 3]
        kind = "y/z" if i < 60 else "" if kind == "y/z" else kind
        rows.append((i, f"https://nest.test/{'/'.join(nest[: 16 + i % 6 if kind else 1 + i % 21])}/{kind}" if i < 2900 else f"https://plain.test/{i}"))
        marks.append((i, int(kind != "y/z" and rng.random() > (0.02 if kind else 0.35)), 0))
    rows += [(5000, "https://new.test/y/z"), (5001, "https://new.test/y"), (5002, "https://new.test/z")]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i]["verdict"] for i in (5000, 5001, 5002)] == ["block", "allow", "allow"] and got[5000]["mined_confidence"] == pytest.approx(1.0)


def test_very_long_urls(spark):
    long = "https://long.test/" + "/".join(f"p{'q' * (i % 50)}" for i in range(50_000))
    rows = [(i, long if i < 60 else f"https://plain.test/{i}") for i in range(300)]
    marks = [(i, int(i >= 60), 0) for i, _ in rows]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block" if i < 60 else "allow") for i in got)


def test_ties_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = (("allow", "org/"), ("block", "org/"))
    assert [judge_urls(pages, none, rules).first()["verdict"] for rules in (same, same[::-1])] == ["block", "allow"]


def test_no_python_in_the_plan(spark, sf):
    plan = op4_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in chain(("Python", "Pandas", "Arrow")))
