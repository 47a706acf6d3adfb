"""The perturbed forecast added up in blocks, against a row for each pair and step."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from netreach.operators import contribution, forecast
from netreach.registry import catalog


@pytest.mark.parametrize("block, dampen", [(4, 0.5), (64, None)])
def test_model_risk(spark, block, dampen):
    r = random.Random(5)
    names = ["C_a", "C_b", "C_c"] + [f"W_{i}" for i in range(8)]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(weeks=k) for k in range(14)]
    series = spark.createDataFrame([(d, w, r.uniform(1, 9)) for d in days for w in names if r.random() < 0.95 or w == "C_a"], "t date, node string, x double")
    pairs = [(d, *r.sample(names, 2)) for d in days for _ in range(12)] + [(d, w, w) for d in days for w in names[::2]]
    edges = spark.createDataFrame([(*p, r.uniform(0.1, 2)) for p in sorted(set(pairs))], "t date, src string, dst string, w double")
    table = forecast.training_table(series, edges, max_gap_weeks=3)
    model = forecast.fit(table, forecast.columns(4))
    pred, z = forecast.predict(model, table), forecast.scaled_series(series)[0]
    timewise = contribution.model_perturbation(edges, z, pred, model.coefficients, self_dampen=dampen)
    want = {(x.src, x.dst): (x.risk, x["std"]) for x in contribution.collapse_risk(timewise, pred).collect()}
    got = contribution.model_risk(edges, z, pred, model.coefficients, self_dampen=dampen, block=block).collect()
    assert len(got) == len(want) > 60
    for x in got:
        assert (x.risk, x["std"]) == pytest.approx(want[x.src, x.dst], abs=1e-9)
    assert dampen is not None or all(x.src != x.dst for x in got)


def test_query_lists_no_pairs_by_step(spark, monkeypatch):
    """The two-hop product of all pairs of sites in every step filled the disks."""
    monkeypatch.setattr(contribution, "product", lambda *a, **k: pytest.fail("pairs are listed by step"))
    got = catalog.QUERIES["M22_perturbation_model"](spark, "/root/testdata/sf0.001")
    assert got.filter(F.col("risk").isNull()).count() == 0 < got.count()
