"""The sub-matrix of sites added up without its pairs, against the listed pairs."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from netreach.operators import network
from netreach.registry import catalog
from netreach.sources import sinks


@pytest.mark.parametrize("block, tile, heads", [(3, 2, 1), (100, 4, 50)])
def test_rows_of_the_sub_matrix(spark, monkeypatch, block, tile, heads):
    """Sites with flow in one direction only, with volumes of zero, alone in a step, and with equal lists of counties."""
    monkeypatch.setattr(network, "TILE", tile)
    monkeypatch.setattr(network, "HEADS", heads)
    r, rows = random.Random(11), [(datetime.date(2024, 9, 1), "C_0", "W_0", 2.0), (datetime.date(2024, 9, 1), "W_0", "C_0", 3.0)]
    for t in (1, 2, 3):
        for c in range(6):
            for w in range(19):
                if r.random() < 0.3 and w != 3:
                    rows.append((datetime.date(2024, t, 1), f"C_{c}", f"W_{w}", float(r.randrange(5))))
                if r.random() < 0.3 and w != 5:
                    rows.append((datetime.date(2024, t, 1), f"W_{w}", f"C_{c}", float(r.randrange(5))))
    f = spark.createDataFrame(rows, "t date, src string, dst string, w double")
    listed = sinks.sub_matrix(network.projections(f), "W_").groupBy("t", "src").agg(F.count(F.lit(1)).alias("cells"), F.sum("w").alias("w"))
    key = lambda df: sorted((x.t, x.src, x.cells, round(x.w, 9)) for x in df.collect())
    assert key(network.projection_rows(f, kinds=("WW",), block=block)) == key(listed)


def test_query_lists_no_pairs(spark, monkeypatch):
    """The list of all pairs of sites in every step filled the disks."""
    monkeypatch.setattr(network, "product", lambda *a, **k: pytest.fail("pairs are listed"))
    assert catalog.QUERIES["S15_sub_matrix"](spark, "/root/testdata/sf0.001").count() > 0
