"""Greedy covers, farthest-first orders, components, nearest neighbours and the linear forecast, against plain Python."""
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netreach.operators import contribution, forecast, graph, network
from netreach.operators.spread import farthest_first, hull
from netreach.plans import greedy, ordering, skew


def plain_greedy(cov, mass, tie):
    open_, out = set(mass), []
    while True:
        gain = {w: round(sum(mass[i] for i in items & open_), 6) for w, items in cov.items()}
        best = min(cov, key=lambda w: (-gain[w], tie[w], w), default=None)
        if best is None or gain[best] <= 0:
            return out
        out.append((best, gain[best]))
        open_ -= cov[best]


@pytest.mark.parametrize("task_pairs", [5, 40, 10_000])
def test_greedy_cover(spark, task_pairs):
    r = random.Random(4)
    groups, rows, ties = {}, [], []
    for g in ("a", "b", "c"):
        names = [f"w{i:02d}" for i in range(r.choice([3, 25]))]
        mass = {str(i): 1.0 + i % 3 for i in range(30)}
        cov = {w: set(r.sample(sorted(mass), r.randrange(0, 8))) for w in names}
        tie = {w: float(r.randrange(3)) for w in names}
        groups[g] = plain_greedy(cov, mass, tie)
        rows += [(g, w, i, mass[i]) for w in names for i in cov[w]] * 2
        ties += [(g, w, tie[w]) for w in names]
    pairs, tied = spark.createDataFrame(rows, "g string, wwtp string, item string, mass double"), spark.createDataFrame(ties, "g string, wwtp string, tie double")
    for limit in (None, 3):
        got = greedy.greedy_cover(pairs, tied, ["g"], limit, task_pairs).collect()
        for g, want in groups.items():
            mine = sorted((x.ord, x.wwtp, x.gain) for x in got if x.g == g)
            assert mine == [(k, *p) for k, p in enumerate(want[:limit], 1)]
    one = greedy.greedy_cover(pairs.filter("g = 'a'").drop("g"), tied.filter("g = 'a'").drop("g"), None, None, task_pairs)
    assert [(x.wwtp, x.gain) for x in one.orderBy("ord").collect()] == groups["a"] and "_group" not in one.columns
    assert greedy.greedy_cover(pairs.limit(0), tied, ["g"]).count() == 0


def test_few_rounds(spark, monkeypatch):
    """A round takes many picks."""
    rounds = []
    real = greedy._round
    monkeypatch.setattr(greedy, "_round", lambda *a: rounds.append(1) or real(*a))
    pairs = spark.range(4000).select(F.concat(F.lit("w"), F.floor(F.col("id") / 4)).alias("wwtp"), (F.xxhash64("id") % 1500).cast("string").alias("item"), F.lit(1.0).alias("mass"))
    tie = pairs.select("wwtp").distinct().withColumn("tie", F.lit(0.0))
    assert greedy.greedy_cover(pairs, tie, task_pairs=1000).count() > 300 and 0 < len(rounds) < 25


def plain_farthest(pts, start, n):
    left, at = list(pts), list(start)
    out = []
    while left and len(out) < n:
        if not at:
            key = lambda p: (round(sum(math.dist(p[1:3], q[1:3]) for q in pts) / max(1, len(pts) - 1), 6), p[3], p[0])
        else:
            key = lambda p: (round(min(math.dist(p[1:3], q) for q in at), 6), p[3], p[0])
        best = max(left, key=key)
        left.remove(best)
        out.append(best[0])
        at.append(best[1:3])
    return out


@pytest.mark.parametrize("lattice", [False, True])
def test_farthest_first(spark, lattice):
    r = random.Random(7)
    pts = [(f"s{i:03d}", r.choice([r.uniform(0, 100), r.gauss(30, 1)]), r.uniform(0, 60), float(r.randrange(3))) for i in range(400)]
    if lattice:
        pts = [(w, float(round(x / 8)), float(round(y / 8)), s) for w, x, y, s in pts]
    lost = [("zz", None, None, 0.1), ("zy", None, 1.0, 0.1), ("zx", None, None, 0.5)]
    df = spark.createDataFrame(pts + lost, "wwtp string, x double, y double, score double")
    got = [x.wwtp for x in farthest_first(df, None, None).orderBy("ord").collect()]
    assert got == plain_farthest(pts, [], 400) + ["zx", "zz", "zy"]
    chosen = spark.createDataFrame([(5.0, 5.0), (90.0, 50.0)], "x double, y double")
    got = [(x.ord, x.wwtp) for x in farthest_first(df, chosen, 30).orderBy("ord").collect()]
    assert got == list(enumerate(plain_farthest(pts, [(5.0, 5.0), (90.0, 50.0)], 30), 1))
    assert farthest_first(df.limit(0), None, 5).count() == 0
    assert [x.wwtp for x in farthest_first(df.filter("x is null"), chosen, None).orderBy("ord").collect()] == ["zx", "zz", "zy"]


def test_hull():
    square = np.array([[0, 0], [0, 4], [4, 0], [4, 4], [2, 2], [2, 0], [0, 0]], float)
    assert {tuple(p) for p in hull(square)} == {(0, 0), (0, 4), (4, 0), (4, 4)}


def test_components(spark):
    r = random.Random(2)
    nodes = [f"n{i:04d}" for i in range(600)]
    edges = [tuple(r.sample(nodes, 2)) for _ in range(350)] + list(zip(nodes[100:160], nodes[101:161], strict=True)) + [(nodes[0], nodes[0]), ("gone", nodes[1])]
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a in parent and b in parent:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    sizes = {}
    for v in nodes:
        sizes[root(v)] = sizes.get(root(v), 0) + 1
    got = graph.components(spark.createDataFrame([(v,) for v in nodes], "wwtp string"), spark.createDataFrame(edges, "u string, v string"))
    assert {(x.wwtp, x.component, x.component_size) for x in got.collect()} == {(v, root(v), sizes[root(v)]) for v in nodes}
    assert graph.components(got.limit(0).select("wwtp"), spark.createDataFrame([], "u string, v string")).count() == 0


@pytest.mark.parametrize("centre", [0, 10**6])
def test_giant_star(spark, centre):
    n = 100_000
    star = spark.range(1, n).select(F.lit(centre).cast("long").alias("u"), F.col("id").alias("v"))
    got = graph.components(spark.range(n).union(spark.range(centre, centre + 1)).withColumnRenamed("id", "wwtp"), star)
    assert got.filter(f"component = {0 if centre == 0 else 1}").select("component_size").distinct().collect()[0][0] == n


@pytest.mark.parametrize(("parts", "rounds", "kept"), [(1, 1, 200_000), (4, 9, 200_000), (1, 9, 7)])
def test_small_graph_takes_one_round(spark, monkeypatch, parts, rounds, kept):
    """A task shortens what it holds, in pieces if it holds much, so a long path in one task is a star before the first round."""
    taken = []
    star = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda e: taken.append(1) or star(e))
    monkeypatch.setattr(graph, "TASK_NODES", kept)
    forests = graph._forests
    monkeypatch.setattr(graph, "_forests", lambda e: forests(e.repartition(parts)))
    n = 60
    path = [(f"{i:03}", f"{i + 1:03}") for i in random.Random(3).sample(range(n), n) if i != 40]
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(n + 2)], "wwtp string")
    got = {x.wwtp: (x.component, x.component_size) for x in graph.components(nodes, spark.createDataFrame(path, "u string, v string")).collect()}
    assert got == {f"{i:03}": ("000", 41) if i <= 40 else ("041", 20) if i <= n else ("061", 1) for i in range(n + 2)}
    assert len(taken) <= rounds


def test_join_by_share_keeps_heavy_rows_apart(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") < 6_000, 0).otherwise(F.col("id")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.join_by_share(rows, side, "k", "n")
    assert joined.count() == 10_000 and joined.filter("k = 0 and n = 6000").count() == 6_000
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("far", [False, True])
def test_nearest_other(spark, far):
    r = random.Random(5)
    pts = [(f"p{i % 3}", f"s{i}", r.choice([r.uniform(0, 100), float(r.randrange(5))]), r.uniform(0, 100) * r.choice([1, 0.001])) for i in range(300)]
    pts[3] = ("p0", "s3", *pts[0][2:])
    if far:
        pts[1] = ("p1", "s1", 1e6, -1e6)
    pts.append(("p9", "alone", 1.0, 1.0))
    df = spark.createDataFrame([*pts, ("p0", "lost", None, 1.0)], "g string, wwtp string, x double, y double")
    for parts, same in ((["g"], lambda a, b: a[0] == b[0]), (None, lambda a, b: True)):
        got = {x.wwtp: x.nearest_km for x in graph.nearest_other(df, parts).collect()}
        for p in pts:
            assert got[p[1]] == pytest.approx(min((math.dist(p[2:], q[2:]) for q in pts if q[1] != p[1] and same(p, q)), default=math.inf), abs=1e-9)
        assert got["lost"] == math.inf


def test_order_over_many_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.xxhash64("id") % 50).alias("v"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = ordering.running_sums(rows, ["g"], [F.col("v"), F.col("id")], {"s": F.col("id"), "n": F.lit(1)}).collect()
        empty = ordering.number_rows(rows.limit(0), [], [F.col("v")], "n").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert empty == 0
    for g in range(7):
        total = 0
        for k, x in enumerate(sorted((x for x in got if x.g == g), key=lambda x: (x.v, x.id)), 1):
            total += x.id
            assert (x.n, x.s) == (k, total)


@pytest.fixture(scope="module")
def six(spark):
    """Six nodes over 30 weeks and a graph whose weights change each week."""
    r = random.Random(9)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(weeks=k) for k in range(30)]
    names = ["C_a", "C_b", "C_c", "W_x", "W_y", "W_z"]
    series = [(t, n, 50 + 20 * math.sin(k / 3 + i) + r.uniform(0, 9)) for k, t in enumerate(days) for i, n in enumerate(names)]
    edges = [(t, a, b, r.uniform(0.1, 2)) for t in days for a in names for b in names if (a[0] != b[0] or a == b) and r.random() < 0.8]
    return spark.createDataFrame(series, "t date, node string, x double"), spark.createDataFrame(edges, "t date, src string, dst string, w double"), names


def test_moments_solve_the_ridge(spark, six):
    series, edges, _ = six
    cols = forecast.columns(4)
    table = forecast.training_table(series, edges)
    sums = forecast.moments(table, cols)
    train = table.filter("split = 'train'").toPandas()
    x, y = train[cols].to_numpy(float), train["target"].to_numpy(float)
    for ridge in (0.01, 1.0):
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc / len(x) + ridge * np.eye(len(cols)), xc.T @ yc / len(x))
        model = sums.solve(ridge)
        assert np.allclose(list(model.coefficients.values()), want, atol=1e-8)
        pred = forecast.predict(model, table).toPandas()
        assert np.allclose(pred["pred_scaled"], table.toPandas()[cols].to_numpy(float) @ want + model.intercept, atol=1e-8)
    with pytest.raises(ValueError):
        forecast.fit(table.limit(0), cols)


def test_perturbation_equals_rescoring(spark, six):
    """The chain rule against scoring again with one node's values shrunk at a time."""
    series, edges, names = six
    cols = forecast.columns(4)
    table = forecast.training_table(series, edges)
    model = forecast.fit(table, cols)
    pred = forecast.predict(model, table)
    z = forecast.scaled_series(series)[0]
    got = contribution.model_perturbation(edges, z, pred, model.coefficients, alpha=0.3, self_dampen=0.5).toPandas()
    base = pred.toPandas().set_index(["t", "node"])["pred_scaled"]
    dev = base.groupby("node").std(ddof=0) + 1e-6
    found = {}
    for name in names:
        shrunk = z.withColumn("z", F.col("z") * F.when(F.col("node") == name, 0.7).otherwise(1.0))
        hops = network.diffuse(edges, shrunk, ["z"], 2).toPandas().set_index(["t", "node"]).sort_index()
        again = pred.toPandas().set_index(["t", "node"])
        for (t, node), row in again.iterrows():
            own = hops.xs(node, level="node")
            past = own[own.index < t].iloc[-4:]
            new = {f"lag{4 - i}": v for i, v in enumerate(past["z"])} | {"hop1": past["z_hop1"].iloc[-1], "hop2": past["z_hop2"].iloc[-1]}
            score = model.intercept + sum(b * new.get(c, row[c]) for c, b in model.coefficients.items())
            found[t, name, node] = abs(score - base[t, node]) / dev[node] / (abs(base[t, node]) + 1e-6)
    top = max(found.values())
    mine = {(x.t, x.src, x.dst): x.risk for x in got.itertuples()}
    assert mine.keys() <= found.keys()  # a node out of reach of two hops changes nothing
    for key, v in found.items():
        assert mine.get(key, 0.0) == pytest.approx(v / top * (0.5 if key[1] == key[2] else 1), abs=1e-9)
    off = contribution.model_perturbation(edges, z, pred, model.coefficients)
    assert off.filter("src = dst").count() == 0


def test_pair_corr(spark, six):
    series, _, names = six
    pairs = spark.createDataFrame([("C_a", "W_x"), ("C_b", "C_c"), ("C_a", "nobody")], "i string, j string")
    wide = series.toPandas().pivot(index="t", columns="node", values="x")
    got = {(x.i, x.j): x.corr for x in contribution.pair_corr(series, pairs).collect()}
    assert got == {k: pytest.approx(abs(wide[k[0]].corr(wide[k[1]])), abs=1e-9) for k in (("C_a", "W_x"), ("C_b", "C_c"))}
