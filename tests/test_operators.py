"""Small cases with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.functions import aggregates, arrays, scalar, times
from riskloom.operators import graph, profiles, relational, rules, scores, sequences
from riskloom.plans.aggspec import AggSpec, compile_specs, event_specs, payment_specs
from riskloom.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_sessions_forward_gap_within_a_day(spark):
    rows = frame(spark, [(1, t * 1_000_000, i) for i, t in enumerate((0, 100, 800, 90_000, 176_405))], "u int, us long, id int")
    gaps = sequences.lead_gap(rows, "u", ["us", "id"], "us", "gap").orderBy("id")
    assert [r["gap"] for r in gaps.collect()] == [100, 700, 2800, 5, 99_999]
    assert [r["s"] for r in sequences.sessions(rows, "u", ["us", "id"], "us", "s").orderBy("id").collect()] == [0, 0, 1, 2, 2]
    whole = sequences.sessions(rows, "u", ["us", "id"], "us", "s", within_day=False).orderBy("id")
    assert [r["s"] for r in whole.collect()] == [0, 0, 1, 2, 3]


def test_transition_score(spark):
    rows = [("A", 0), ("A", 10), ("B", 50), ("B", 60), ("A", 100), ("B", 250)]
    df = frame(spark, [(1, m, t * 1_000_000, i) for i, (m, t) in enumerate(rows)] + [(2, "A", 0, 9)], "u int, m string, us long, id int")
    out = sequences.transition_score(df, "u", ["us", "id"], "us", F.col("m") == "A", F.col("m") == "B", "s").orderBy("u")
    assert [r["s"] for r in out.collect()] == pytest.approx([1 / 191, 0.0])


def test_skew(spark):
    df = frame(spark, [(1, float(x)) for x in (1, 2, 2, 7, 11)] + [(2, 4.0)] * 3 + [(3, 1.0), (3, 9.0)], "k int, v double")
    got = dict(values(df.groupBy("k").agg(aggregates.skew(F.col("v")).alias("s")), "k", "s"))
    assert got[1] == pytest.approx(1.0334081612) and got[2] == 0 and got[3] is None


def test_sum_of_nothing_is_zero(spark):
    df = frame(spark, [(1, None)], "k int, v double")
    r = df.groupBy("k").agg(aggregates.sum0(F.col("v")).alias("s"), F.count_distinct("v").alias("d"), F.avg("v").alias("m")).first()
    assert (r["s"], r["d"], r["m"]) == (0, 0, None)


def test_overlap_counts_null_as_a_member(spark):
    ops = frame(spark, [(1, "a"), (1, None), (2, "a")], "u int, v string")
    trades = frame(spark, [(1, "a"), (1, None), (1, "b")], "u int, v string")
    got = dict(values(profiles.set_overlap(ops, trades, "u", "v", "j"), "u", "j"))
    assert got == {1: pytest.approx(2 / 3), 2: None}


def test_favourite_top_two_and_mode(spark):
    df = frame(spark, [(1, v) for v in ("x", "x", "y", "y", None)], "u int, v string")
    assert values(profiles.favourite(df, "u", "v"), "v_favourite", "v_favourite_count", "v_favourite_rate") == [("y", 2, 0.4)]
    assert values(profiles.top_two(df, "u", "v"), "v_top1", "v_top2", "v_second_ratio") == [("x", "y", 1.0)]
    numbers = frame(spark, [(1, 3), (1, 3), (1, 5), (2, 3), (2, 3), (3, 1), (3, 1), (3, 2), (3, 2)], "k int, v int")
    assert dict(values(profiles.mode_if_mixed(numbers, ["k"], "v", "m"), "k", "m")) == {1: 3, 2: None, 3: 1}


def test_edges_and_diffusion(spark):
    df = frame(spark, [(1, "m")] * 3 + [(2, "m"), (3, None)], "u int, m string")
    assert sorted(values(graph.bipartite_edges(df, "u", "m"), "u", "node", "ratio")) == [(1, 1_000_000, 0.75), (2, 1_000_000, 0.25)]


def test_codes(spark):
    df = frame(spark, [(1, None, "b", None), (2, "a", None, "z"), (3, None, None, None), (4, "a", "b", None)], "id int, a string, b string, c string")
    out = df.orderBy("id").select(
        scalar.pair_presence("a", "b").alias("pair"), scalar.device_kind("a", "a", "c").alias("kind"), scalar.joined_codes("a", "b", "c").alias("joined"), scalar.first_known("a", "b", "c").alias("known"), scalar.null_count("a", "b", "c").alias("nulls")
    )
    assert values(out, "pair", "kind", "joined", "known", "nulls") == [(1, -1, "b", "b", 2), (2, 1, "az", "a", 1), (-1, -1, None, None, 3), (3, 1, "ab", "a", 1)]


def test_last_dictionary_entry_wins(spark):
    classes = {"one": ("HUA",), "two": ("vivo",), "three": ("X9",)}
    df = frame(spark, [(0, None), (1, "zzz"), (2, "vivo X8 HUA"), (3, "vivo X9 HUA"), (4, "nan")], "id int, t string").orderBy("id")
    assert [r[0] for r in df.select(scalar.last_match("t", classes)).collect()] == ["-1", "others", "two", "three", "-1"]


def test_fill_and_change(spark):
    df = frame(spark, [(1, i, v) for i, v in enumerate((None, "a", None, "b"))], "u int, id int, v string")
    assert [r["v"] for r in sequences.fill_forward(df, "u", ["id"], ["v"]).orderBy("id").collect()] == [None, "a", "a", "b"]
    assert [r["v"] for r in sequences.fill_backward(df, "u", ["id"], ["v"]).orderBy("id").collect()] == ["a", "a", "b", "b"]
    df = frame(spark, [(1, i, v) for i, v in enumerate(("a", "a", None, None, "b"))], "u int, id int, v string")
    assert [r["v_changed"] for r in sequences.change_flags(df, "u", ["id"], ["v"]).orderBy("id").collect()] == [1, 0, 1, 0, 1]


def test_parts_and_rank(spark):
    df = frame(spark, [(1, -2.0), (2, 0.0), (3, 3.0), (4, None)], "id int, v double").orderBy("id")
    assert values(df.select(scalar.positive_part("v").alias("p"), scalar.negative_part("v").alias("n")), "p", "n") == [(0, -2), (0, 0), (3, 0), (0, 0)]
    ranked = sequences.average_rank(frame(spark, [(1, x) for x in (10, 20, 20, 30)], "k int, v int"), "k", "v", "r")
    assert sorted(r["r"] for r in ranked.collect()) == [1, 2.5, 2.5, 4]


def test_rates_and_rules(spark):
    df = frame(spark, [(1, "p", True), (2, "p", False), (3, "q", True), (3, "q", True)], "u int, a string, bad boolean")
    rates = rules.attribute_rates(df, "u", "a", F.col("bad"))
    assert sorted(values(rates, "a", "ratio", "support")) == [("p", 0.5, 2), ("q", 1.0, 1)]
    score = frame(spark, [(1, 0.2), (2, 0.3), (3, 0.4)], "u int, s double")
    first, second = frame(spark, [(1,), (2,)], "u int"), frame(spark, [(2,)], "u int")
    assert sorted(values(rules.overridden(score, "u", "s", [(first, F.lit(0.0)), (second, F.lit(1.0))]), "u", "s")) == [(1, 0.0), (2, 1.0), (3, 0.4)]


def test_weighted_tpr(spark):
    rows = list(zip((0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2), (1, 0, 1, 1, 0, 0, 1, 0, 0, 0), range(10), strict=True))
    assert scores.weighted_tpr(frame(spark, rows, "s double, y int, id int"), "s", "y", "id").first()[0] == pytest.approx(0.25)


def test_fused_specs_leave_out_groups_without_rows(spark):
    df = frame(spark, [(7, 1, 5, 3), (7, 2, 9, 12)], "UID int, day int, value int, hour int")
    r = compile_specs(df, "UID", [AggSpec(("day",), "value", "count", "hour < 10")]).first()
    assert (r["UID_day_count_value_max"], r["UID_day_count_value_min"], r["UID_day_count_value_mean"]) == (1, 1, 1)


def test_spec_catalogue():
    names = [s.name("UID") for s in event_specs() + payment_specs()]
    assert (len(event_specs()), len(payment_specs()), len(set(names))) == (71, 54, 125)
    assert {"UID_device2_channel_var_day", "UID_day_hour_var_ude5_is_oper", "UID_market_code_sum_ude300_time_diff_secd", "UID_day_mod_bal_increase"} <= set(names)


def test_unions(spark):
    a, b = frame(spark, [(1, "x")], "UID int, a string"), frame(spark, [(2, "y")], "UID int, b string")
    assert sorted(relational.union_filled(a, b).columns) == ["UID", "a", "b"] and relational.union_filled(a, b).count() == 2
    assert relational.union_common(a, b).columns == ["UID"]


def test_chunks(spark):
    df = frame(spark, [([1, 2, 3, 4],), ([],)], "l array<int>")
    assert [r[0] for r in df.select(arrays.chunks(F.col("l"), 3)).collect()] == [[[1, 2, 3], [4, None, None]], []]


def test_times(spark):
    df = frame(spark, [(5, "10:20:30"), (None, "10:20:30"), (5, None), (5, "x")], "d int, t string")
    out = df.select(times.at_time("2018-10-31", F.col("d"), F.col("t")).cast("string").alias("ts"), times.hour_of_text(F.col("t")).alias("h"))
    assert values(out, "ts", "h") == [("2018-11-05 10:20:30", 10), (None, 10), (None, None), (None, None)]


def test_walks_are_repeatable_and_follow_edges(spark):
    edges = frame(spark, [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    for weighted in (False, True):
        one = sorted(map(tuple, graph.random_walks(edges, 2, 5, weighted=weighted).collect()))
        assert one == sorted(map(tuple, graph.random_walks(edges, 2, 5, weighted=weighted).collect()))
        linked = {(1, 2), (2, 3), (3, 1), (3, 4)}
        for _, _, start, nodes in one:
            assert nodes[0] == start and all(p in linked for p in zip(nodes, nodes[1:], strict=False)) and (nodes[-1] == 4 or len(nodes) == 5)


def test_text_formats(spark, tmp_path):
    (tmp_path / "emb.txt").write_text("2 3\n7 0.5 1 2\n9 1 1 1\n")
    assert sorted(values(files.read_embeddings(spark, str(tmp_path / "emb.txt")), "id", "vector")) == [("7", [0.5, 1, 2]), ("9", [1, 1, 1])]
    (tmp_path / "edges.txt").write_text("1 2 0.5\n2 3\n")
    assert sorted(values(files.read_edges(spark, str(tmp_path / "edges.txt")), "src", "dst", "weight")) == [(1, 2, 0.5), (2, 3, 1.0)]
    assert files.read_edges(spark, str(tmp_path / "edges.txt"), undirected=True).count() == 4
    (tmp_path / "adj.txt").write_text("# nodes\n1 3 2 2 1\n2 1\n")
    assert sorted(values(files.read_adjacency(spark, str(tmp_path / "adj.txt")), "node", "neighbours")) == [(1, [2, 3]), (2, [1])]
    assert sorted(values(files.read_adjacency(spark, str(tmp_path / "adj.txt"), checked=False), "node", "neighbours")) == [(1, [3, 2, 2, 1]), (2, [1])]
    df = frame(spark, [(1, "é"), (2, "中")], "id int, t string")
    files.write_csv(df, str(tmp_path / "csv"), encoding="GBK")
    assert sorted(values(files.read_csv(spark, str(tmp_path / "csv"), "id int, t string", encoding="GBK"), "id", "t"))[1] == (2, "中")
    with pytest.raises(Exception, match="already exists"):
        files.write_csv(df, str(tmp_path / "csv"))
    walks = graph.random_walks(frame(spark, [(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double"), 2, 3)
    files.write_walks(walks, str(tmp_path / "walks"))
    assert files.walks_written(spark, str(tmp_path / "walks"), 4) and not files.walks_written(spark, str(tmp_path / "none"), 4)
    assert files.read_walks(spark, str(tmp_path / "walks")).count() == 4
    assert [r[0] for r in files.fixed_lines(frame(spark, [(1, 2, 0.5)], "a int, b int, c double"), "%d %d %f", "a", "b", "c").collect()] == ["1 2 0.500000"]
    assert [r[0] for r in files.edge_lines(frame(spark, [(1, 2, 0.5)], "src int, dst int, weight double")).collect()] == ["1 2 {'weight': 0.5}"]
    assert files.line_counts(spark, str(tmp_path / "edges.txt")).first()["lines"] == 2
    assert files.files_under(spark, str(tmp_path / "walks")).count() >= 1
    files.write_embeddings(files.read_embeddings(spark, str(tmp_path / "emb.txt")), str(tmp_path / "emb2"))
    assert files.read_embeddings(spark, str(tmp_path / "emb2")).count() == 2
