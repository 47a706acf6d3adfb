"""Equal polygons are met once, and tables of cells are never broadcast."""
from pyspark.sql import functions as F

from netreach.operators import areal, baselines
from netreach.plans import greedy


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


RING = "ring array<struct<x: double, y: double>>"


def test_cells_are_not_broadcast(spark):
    """The planner takes cells for as small as their rings: a few kilobytes here."""
    sites = spark.createDataFrame([(f"s{i}", square(i, i, 30.25)) for i in range(20)], f"wwtp string, {RING}")
    areas = spark.createDataFrame([(f"a{i}", square(i, 2 * i, 3.25)) for i in range(20)], f"area_id string, {RING}")
    a, s = areal.staged_cells(areas, 2.0, "area_id"), areal.staged_cells(sites, 2.0, "wwtp")
    attributes = areas.select("area_id", F.lit(42.25).alias("area"))
    for df in (areal.overlap_area(a, s, 2.0), areal.union_share(a, s, attributes, 2.0)):
        assert "Broadcast" not in plan(df)
    met = areal.site_radius(s, a.withColumnRenamed("area_id", "zip"), areas.select(F.col("area_id").alias("zip"), F.lit(1.0).alias("miles")))
    assert "SortMergeJoin [cx" in plan(met)


def test_greedy_pairs_are_not_broadcast(spark, monkeypatch):
    seen = []
    real = greedy.stage
    monkeypatch.setattr(greedy, "stage", lambda df: seen.append(plan(df)) or real(df))
    pairs = spark.range(50).select(F.concat(F.lit("w"), F.col("id") % 9).alias("wwtp"), F.lit(1.0).alias("mass"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("item"))
    greedy.greedy_cover(pairs, pairs.select("wwtp").distinct().withColumn("tie", F.lit(0.0)), limit=2)
    assert "Broadcast" not in seen[0]


def test_shapes(spark):
    rows = [(f"s{i:02d}", square(10 * (i % 3), 0, 4.25)) for i in range(12)] + [("none", None)]
    rings, members = areal.shapes(spark.createDataFrame(rows, f"wwtp string, {RING}"), "wwtp")
    assert sorted(r.wwtp for r in rings.collect()) == ["s00", "s01", "s02"]
    assert {r.wwtp: r["shape"] for r in members.collect()} == {f"s{i:02d}": f"s{i % 3:02d}" for i in range(12)}
    each = areal.expand_shapes(areal.rasterize(rings, 2.0, "wwtp"), members, "wwtp")
    plain = areal.rasterize(spark.createDataFrame(rows, f"wwtp string, {RING}"), 2.0, "wwtp")
    order = lambda df: sorted(map(tuple, df.select("wwtp", "cx", "cy").collect()))
    assert order(each) == order(plain)


def test_polygon_order_of_equal_sites(spark):
    """Of sites with one shape the first by population, then name, is taken for all."""
    rows = [(f"s{i:02d}", square(6 * (i % 5), 3 * (i % 2), 2.25 + i % 5)) for i in range(20)]
    polys = spark.createDataFrame(rows, f"wwtp string, {RING}")
    feats = spark.createDataFrame([(w, float(i % 7)) for i, (w, _) in enumerate(rows)][1:], "wwtp string, pop_served double")
    rings, members = areal.shapes(polys, "wwtp")
    got = baselines.greedy_new_polygon_area(areal.rasterize(rings, 2.0, "wwtp"), feats, 4.0, 3, True, members)
    want = baselines.greedy_new_polygon_area(areal.rasterize(polys, 2.0, "wwtp"), feats, 4.0, 3, True)
    order = lambda df: [tuple(r) for r in df.orderBy("ord").collect()]
    assert order(got) == order(want) and len(order(want)) == 19
