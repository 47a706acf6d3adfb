"""Exported site edges against all pairs in plain Python."""
import math
import random

import pytest
from pyspark.sql import functions as F

from netreach.operators import graph
from netreach.sources import sinks


def test_export_edges(spark):
    r = random.Random(4)
    rows = [(f"s{k}", f"Site {k}", float(r.randrange(40)), float(r.randrange(40)), r.choice([0.5, 2.0, 3.0, 9.0])) for k in range(60)]
    rows += [("t1", "one", 7.0, 7.0, 1.0), ("t2", None, 7.0, 7.0, 1.0), ("t3", "no radius", 7.0, 7.0, None), ("t4", "nowhere", None, 7.0, 9.0)]
    n = spark.createDataFrame(rows, "wwtp string, name string, x double, y double, radius double")
    comps = n.filter("wwtp <> 't2'").select("wwtp", F.concat(F.lit("of "), "wwtp").alias("component"))
    want = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and None not in (a[4], b[4], a[2], b[2]):
                d = math.hypot(a[2] - b[2], a[3] - b[3])
                if d <= a[4] + b[4]:
                    want.append((a[0], b[0], a[1], b[1], round(d, 9), None if a[0] == "t2" else "of " + a[0]))
    got = [(x.u, x.v, x.u_name, x.v_name, round(x.distance_km, 9), x.component) for x in sinks.export_edges(n, comps).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("tasks", [None, 5])
def test_pairs_are_dealt_to_tasks(spark, tasks):
    """The cells of few sites, small on disk, fell to one task that made all pairs."""
    n = spark.range(300).select(F.col("id").cast("string").alias("wwtp"), (F.col("id") % 20 * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(6.0).alias("radius"))
    e = graph.site_edges(n, ("x",), tasks)
    assert e.count() == 20 * 15 * 14 // 2 + 19 * 15 * 15
    used = e.groupBy(F.spark_partition_id()).count().count()
    assert tasks is None or used == tasks
