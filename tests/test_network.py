"""Graph, selection, greedy orders and coverage against brute force."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from netreach.operators import areal, baselines, contribution, coverage, graph, selection
from netreach.sources import driver_tables


def site_frame(spark, rows):
    return spark.createDataFrame(rows, "wwtp string, x double, y double, radius double")


def test_graph(spark):
    r = random.Random(1)
    # dense spot, spread sites, copies of one place, a site without radius
    rows = [(f"d{i:02d}", r.random() * 3, r.random() * 3, 0.05) for i in range(40)]
    rows += [(f"s{i:02d}", r.random() * 900, r.random() * 900, r.choice([2.0, 30.0, 90.0])) for i in range(40)]
    rows += [("c1", 5.0, 5.0, 1.0), ("c2", 5.0, 5.0, 1.0), ("n1", 6.0, 5.0, None)]
    s = site_frame(spark, rows)
    at = {w: (x, y, q) for w, x, y, q in rows}
    want = {
        (a, b) for a, b in itertools.combinations(sorted(at), 2)
        if at[a][2] is not None and at[b][2] is not None and math.dist(at[a][:2], at[b][:2]) <= at[a][2] + at[b][2]
    }
    e = graph.site_edges(s)
    assert sorted((x.u, x.v) for x in e.collect()) == sorted(want)
    root = {w: w for w in at}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in want:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {x.wwtp: (x.component, x.component_size) for x in graph.components(s, e).collect()}
    size = {c: sum(1 for w in at if find(w) == c) for c in at}
    assert got == {w: (find(w), size[find(w)]) for w in at}
    near = {x.wwtp: x.nearest_km for x in graph.nearest_other(s).collect()}
    for w in at:
        assert near[w] == pytest.approx(min(math.dist(at[w][:2], at[o][:2]) for o in at if o != w))
    assert graph.nearest_other(site_frame(spark, [("a", 0.0, 0.0, 1.0)])).first().nearest_km == float("inf")


def greedy(names, cov, rank, quota, first, legacy, gain_min=1):
    """Plain twin of the selection inside one component."""
    chosen, covered, log = [], set(), {}
    for w in first[:quota]:
        chosen.append(w)
        log[w] = ("diffusion_priority", len(cov[w]))
        covered |= cov[w]

    def best(pool, least):
        ok = [(-len(cov[w] - covered), rank[w], w) for w in pool if len(cov[w] - covered) >= least]
        return min(ok) if ok else None

    def saturate():
        nonlocal covered
        while (b := best([w for w in names if w not in chosen], gain_min)) is not None:
            chosen.append(b[2])
            log[b[2]] = ("saturation_component", -b[0])
            covered |= cov[b[2]]

    while len(chosen) < quota and len(chosen) < len(names):
        b = best([w for w in names if w not in chosen], 0)
        chosen.append(b[2])
        log[b[2]] = ("coverage_gain", -b[0])
        covered |= cov[b[2]]
        if legacy:
            saturate()
    if not legacy:
        saturate()
    return chosen, log, {w: len(cov[w] - covered) for w in names if w not in chosen}


@pytest.mark.parametrize("legacy", [True, False])
def test_selection_matches_twin(spark, legacy):
    r = random.Random(11)
    p = selection.SelectionParams(reserve=1, legacy_saturation=legacy, fraction=0.5)
    rows, pairs, comps = [], [], {"k1": 5, "k2": 3, "k3": 1, "k4": 1}
    for month in ("m1", "m2"):
        for c, n in comps.items():
            for i in range(n):
                w = f"{c}_{i}"
                diff = r.random() if (r.random() < 0.3 and n >= 3) else None
                rows.append((month, w, c, n, 1.0, float(r.randrange(4)), 50.0, r.random(), False, False, False, diff is not None, diff))
                pairs += [(month, w, f"{q:05d}") for q in r.sample(range(8), r.randrange(1, 5))]
    sites = spark.createDataFrame(
        rows, "year_month string, wwtp string, component string, component_size int, pop_served double, avg_rank double, nearest_km double, "
        "importance double, low_impact boolean, top_any boolean, bottom_all boolean, is_diffusion boolean, diffusion_score double")
    counties = spark.createDataFrame(pairs, "year_month string, wwtp string, county_fips string")
    got = {(x.year_month, x.wwtp): x for x in selection.select_sites(sites, counties, ["year_month"], p).collect()}
    assert len(got) == len(rows)
    for month in ("m1", "m2"):
        for c, n in comps.items():
            mine = [x for x in rows if x[0] == month and x[2] == c]
            if n == 1:
                continue
            cov = {x[1]: {q for m, w, q in pairs if m == month and w == x[1]} for x in mine}
            rank = {x[1]: x[5] for x in mine}
            first = [x[1] for x in sorted((x for x in mine if x[11]), key=lambda x: (-x[12], x[5], x[1]))]
            chosen, log, left = greedy(sorted(cov), cov, rank, max(1, math.ceil(0.5 * n)), first, legacy)
            for w in cov:
                x = got[(month, w)]
                assert x.selected == (w in chosen)
                if w in chosen:
                    assert (x.method, x.coverage_gain, x.pick) == (*log[w], chosen.index(w) + 1)
                else:
                    assert x.residual_gain == left[w]
        ones = [x for x in rows if x[0] == month and x[3] == 1]
        top = max(ones, key=lambda x: x[7])[1]
        assert {w for (m, w), x in got.items() if m == month and x.component_size == 1 and x.selected} == {top}
    sel = selection.select_sites(sites, counties, ["year_month"], p).filter(F.col("year_month") == "m1").drop("year_month")
    budget = selection.trim_to_budget(sel, 7)
    assert budget.count() == 7 and budget.filter("ord = 1").first().method == "reserved"
    out = selection.expand_order(budget, sel, cap=100).collect()
    assert len(out) == sum(comps.values()) == len({x.wwtp for x in out})


def test_coverage_invariants(spark):
    r = random.Random(8)
    names = [f"w{i}" for i in range(8)]
    w = [(f"{b:012d}", n, r.choice([0.0, 1.0, 0.3, 0.6, 0.9]), 10.0 + b, 2.0) for b in range(12) for n in names if r.random() < 0.6]
    weights = spark.createDataFrame(w, "bg_fips string, wwtp string, w double, population double, area double")
    total = sum({b: p for b, _, _, p, _ in w}.values())
    final = {}
    for tag, seq in (("a", names), ("b", names[::-1])):
        order = spark.createDataFrame([(tag, i + 1, n) for i, n in enumerate(seq)], "strategy string, ord int, wwtp string")
        curves = {}
        for mode in ("cap_sum", "prob_union", "binary"):
            rows = sorted(coverage.union_coverage(order, weights, mode).collect(), key=lambda x: x.ord)
            curves[mode] = [x.cum_population for x in rows]
            assert all(a <= b + 1e-9 for a, b in zip(curves[mode], curves[mode][1:])) and curves[mode][-1] <= total + 1e-9
            final[(tag, mode)] = curves[mode][-1]
            # step by step
            c, s = {}, []
            for n in seq:
                for b, site, v, p, _ in w:
                    if site == n:
                        old = c.get(b, 0.0)
                        c[b] = {"cap_sum": min(1, old + v), "prob_union": 1 - (1 - old) * (1 - v), "binary": 1.0}[mode]
                s.append(sum(c[b] * p for b, p in {(b, p) for b, _, _, p, _ in w} if b in c))
            assert curves[mode] == pytest.approx(s)
        assert all(a >= b - 1e-9 for a, b in zip(curves["cap_sum"], curves["prob_union"]))
    for mode in ("cap_sum", "prob_union", "binary"):
        assert final[("a", mode)] == pytest.approx(final[("b", mode)])


def test_blueprint_slice(spark):
    """Known start of the 1997 summer curve."""
    sf = "/root/testdata/sf0.01"
    links = driver_tables.bg_links(spark, sf).filter(F.col("week").between(dt.date(1997, 6, 1), dt.date(1997, 8, 31)))
    vol = links.filter(F.col("direction") == "Destination").groupBy("wwtp").agg(F.sum("volume").alias("v"))
    order = coverage.as_order(vol, "volume", "v")
    weights = coverage.link_weights(links)
    rows = sorted(coverage.union_coverage(order, weights).filter("ord <= 4").collect(), key=lambda x: x.ord)
    assert [x.wwtp for x in rows] == ["35", "13", "99", "59"]
    assert [round(x.delta_population, 4) for x in rows] == [204.3865, 190.0177, 194.7462, 186.9759]


def test_cells_and_points(spark):
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    df = spark.createDataFrame([("t", [dict(x=x, y=y) for x, y in tri])], "k string, ring array<struct<x:double,y:double>>")
    cells = areal.rasterize(df, 0.1, "k").count() * 0.01
    assert cells == pytest.approx(50, rel=0.02)
    c = df.select(areal.ring_centroid(F.col("ring")).alias("c")).first().c
    assert (c.x, c.y) == pytest.approx((10 / 3, 10 / 3))
    pts = spark.createDataFrame([("in", 2.0, 2.0), ("out", 8.0, 8.0)], "p string, x double, y double")
    assert [r.p for r in areal.point_in_polygon(pts, df, "k", 3.0).collect()] == ["in"]


def test_series_corr_blocks(spark):
    r = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=t), f"n{i}", float(r.randrange(9))) for t in range(12) for i in range(5) if r.random() < 0.8]
    s = spark.createDataFrame(rows, "t date, node string, x double")
    small = {(x.i, x.j): x.corr for x in contribution.series_corr(s, block=2, span_days=5).collect()}
    for a, b in itertools.combinations([f"n{i}" for i in range(5)], 2):
        xa, xb = ({t: x for t, n, x in rows if n == k} for k in (a, b))
        both = sorted(set(xa) & set(xb))
        u, v = [xa[t] for t in both], [xb[t] for t in both]
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        den = math.sqrt(sum((x - mu) ** 2 for x in u) * sum((y - mv) ** 2 for y in v))
        want = abs(sum((x - mu) * (y - mv) for x, y in zip(u, v)) / den) if den else 0.0
        assert small[(a, b)] == pytest.approx(want)
