"""Matrix files, reports, second-order walks and Newton trees, by hand-made files and brute force."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from test_whole_tables import number

from riskloom.operators import graph, learn
from riskloom.operators.boosting import NewtonTrees
from riskloom.sources import files, reports


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + bytes(-len(data) % 8)


def matrix(name, sort, shape, *parts, order="<"):
    flags = element(6, struct.pack(order + "II", sort, 0), order)
    if len(name) <= 4:  # a small element
        tag = struct.pack(order + "I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0")
    else:
        tag = element(1, name.encode(), order)
    return element(14, flags + element(5, struct.pack(order + "ii", *shape), order) + tag + b"".join(parts), order)


def level5(*variables, order="<"):
    return b"made by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(variables)


def ints(values, order="<"):
    return element(5, struct.pack(order + f"{len(values)}i", *values), order)


def doubles(values, order="<"):
    return element(9, struct.pack(order + f"{len(values)}d", *values), order)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("zipped", [False, True])
def test_matrix_files(spark, tmp_path, order, zipped):
    """3 x 3, sparse: cells (2, 0), (0, 1), (1, 1), one stored zero and one place past the end; the same dense."""
    sparse = matrix("network", 5, (3, 3), ints([2, 0, 1, 2, 9], order), ints([0, 1, 3, 4], order), doubles([1.5, 2.0, -3.0, 0.0, 9.0], order), order=order)
    other = matrix("w", 6, (2, 3), element(2, bytes([0, 1, 2, 0, 0, 7]), order), order=order)
    if zipped:
        sparse, other = (struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, (sparse, other)))
    (tmp_path / "g.mat").write_bytes(level5(other, sparse, order=order))
    got = {tuple(r) for r in files.read_matrix_graph(spark, str(tmp_path / "g.mat")).collect()}
    assert got == {(2, 0, 1.5), (0, 1, 2.0), (1, 1, -3.0)}
    dense = Counter(tuple(r) for r in files.read_matrix_graph(spark, str(tmp_path / "g.mat"), "w", undirected=True).collect())
    assert dense == Counter({(1, 0, 1.0): 1, (0, 1, 1.0): 1, (0, 1, 2.0): 1, (1, 0, 2.0): 1, (1, 2, 7.0): 1, (2, 1, 7.0): 1})
    with pytest.raises(Exception, match="no variable x"):
        files.read_matrix_graph(spark, str(tmp_path / "g.mat"), "x").collect()


def test_reports(spark, tmp_path):
    rows = [(1, ' <a> & "b"\r\n', 1.5, True), (2, None, None, None), (3, "x\x01y", -2.0, False)]
    df = spark.createDataFrame(rows, "i long, t string, x double, b boolean").orderBy("i")
    sheet = str(tmp_path / "r.xlsx")
    reports.write_sheet(df, sheet)
    got = reports.read_sheet(spark, sheet, {"i": "long", "t": "string", "x": "double", "b": "int"}).collect()
    assert sorted(map(tuple, got)) == [(1, ' <a> & "b"\r\n', 1.5, 1), (2, None, None, None), (3, "xy", -2.0, 0)]
    with pytest.raises(Exception, match="exists"):
        reports.write_sheet(df, sheet)
    assert [reports._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    chart = str(tmp_path / "r.svg")
    reports.write_bars(df, "i", "x", chart, "<title>")
    assert [tuple(r) for r in reports.read_bars(spark, chart).collect()] == [("1", 1.5), ("3", -2.0)]
    reports.write_bars(df.limit(0), "i", "x", chart, overwrite=True)
    assert reports.read_bars(spark, chart).count() == 0
    with pytest.raises(ValueError, match="at most"):
        reports.write_bars(spark.range(reports.ROWS + 1).withColumn("v", graph.F.lit(1.0)), "id", "v", chart)


def share(own, *marks):
    import xxhash

    mark = 42
    for form, x in zip("iqii", (own, *marks), strict=True):
        mark = xxhash.xxh64_intdigest(struct.pack("<" + form, x), seed=mark)
    return mark % (1 << 30) / float(1 << 30)


def plain_second_order(weights, start, n, steps, p, q, weighted):
    nodes, walk, before = [start], number(start, n), None
    for step in range(1, steps):
        targets = sorted(d for s, d in weights if s == nodes[-1])
        if not targets:
            break
        upto = np.cumsum([weights[nodes[-1], d] if weighted else 1.0 for d in targets])
        offer = 0
        while True:
            x = share(66, walk, step, offer) * upto[-1]
            chosen = targets[min(int((upto <= x).sum()), len(targets) - 1)]
            factor = max(1 / p, 1, 1 / q) if before is None else 1 / p if chosen == before else 1.0 if (before, chosen) in weights else 1 / q
            if share(67, walk, step, offer) * max(1 / p, 1, 1 / q) < factor:
                break
            offer += 1
        before = nodes[-1]
        nodes.append(chosen)
    return nodes


@pytest.mark.parametrize("p, q, weighted", [(4.0, 0.5, False), (0.5, 2.0, True), (1.0, 1.0, False)])
def test_second_order_walks(spark, p, q, weighted):
    pairs = {(a, b): float(1 + (a * b) % 3) for a in range(7) for b in range(7) if a != b and (a + b) % 3}
    pairs[3, 20] = 2.0
    df = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight double")
    got = {(r[2], r[1]): r[3] for r in graph.second_order_walks(df, 3, 5, p, q, weighted=weighted).collect()}
    assert got == {(s, i): plain_second_order(pairs, s, i, 5, p, q, weighted) for s in {n for e in pairs for n in e} for i in (1, 2, 3)}
    with pytest.raises(ValueError):
        graph.second_order_walks(df, 1, 2, p=0)


def plain_newton(x, y, rounds, depth, rate):
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))

    def grow(at, g, h, level):
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[at, f])[:-1]:
                    low, high = at[x[at, f] <= cut], at[x[at, f] > cut]
                    gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (low, high)) - g[at].sum() ** 2 / h[at].sum()
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, low, high
        if best is None or best[0] <= 1e-9:
            step[at] = -g[at].sum() / h[at].sum()
            return
        grow(best[1], g, h, level + 1)
        grow(best[2], g, h, level + 1)

    for _ in range(rounds):
        chance, step = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        grow(np.arange(len(y)), chance - y, chance * (1 - chance), 0)
        margin = margin + rate * step
    return 1 / (1 + np.exp(-margin))


def table(spark, x, y):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    names = [f"x{j}" for j in range(x.shape[1])]
    return learn.assembled(spark.createDataFrame(rows, ["id", *names, "label"]), names)


def chances(model, df):
    return np.array([r["probability"][1] for r in model.transform(df).orderBy("id").select("probability").collect()])


def test_newton_trees_against_brute_force(spark):
    random = np.random.default_rng(5)
    x = random.integers(0, 9, (300, 2)).astype(float)
    y = (random.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 4) + 0.4 * (x[:, 1] > 5)))).astype(float)
    df = table(spark, x, y)
    model = NewtonTrees(rounds=10, depth=2, rate=0.3).fit(df)
    assert np.abs(chances(model, df) - plain_newton(x, y, 10, 2, 0.3)).max() < 1e-6
    assert model.featureImportances[0] > model.featureImportances[1] > 0


def test_newton_trees_that_sample_or_stop(spark):
    random = np.random.default_rng(6)
    x = random.normal(size=(3000, 3))
    y = (random.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    df = table(spark, x, y)

    def auc(p):
        return (p[y == 1][:, None] > p[y == 0][None, :]).mean()

    whole, sampled = (auc(chances(NewtonTrees(rounds=12, depth=3, rate=0.3, top=t).fit(df), df)) for t in (1.0, 0.2))
    assert whole > 0.9 and sampled > whole - 0.03
    held = df.withColumn("held", df["id"] % 3 == 0)
    noise = held.withColumn("label", (graph.F.pmod(graph.F.xxhash64("id"), graph.F.lit(2))).cast("double"))
    model = NewtonTrees(rounds=40, depth=5, rate=0.5, patience=2).stopping_by("held").fit(noise)
    assert 1 <= len(model.trees) < 10
    for label, want in ((0.0, 0.0), (1.0, 1.0)):
        alone = NewtonTrees().fit(df.withColumn("label", graph.F.lit(label)))
        assert chances(alone, df.limit(3)).tolist() == pytest.approx([want] * 3, abs=1e-200)
        assert alone.featureImportances.toArray().tolist() == [0.0] * 3
    assert chances(NewtonTrees().fit(df.limit(0)), df.limit(1)).tolist() == [0.5]
    with pytest.raises(ValueError):
        NewtonTrees(top=0.9, other=0.5)
