"""Risk from the observed cells of the site panel, against the whole panel."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from netreach.operators import panel, risk
from netreach.registry import catalog


def _inputs(spark, seed):
    r = random.Random(seed)
    monday = datetime.date(2024, 1, 1)
    day = lambda: monday + datetime.timedelta(days=r.randrange(70))
    names = ["COVID", "Influenza", "RSV", None]
    rows = [("Sewershed", r.choice("abcdefz"), r.choice(names), day(), r.choice([0.0, 1.0, 2.0, None]), 1.0) for _ in range(90)]
    rows += [("Sewershed", None, "RSV", monday, 1.0, 1.0), ("Sewershed", "a", "RSV", None, 1.0, 1.0), ("County", "a", "RSV", monday, 9.0, 9.0)]
    records = spark.createDataFrame(rows, "region_level string, region string, pathogen string, event_date date, cases double, hospitalized double")
    # g has no record, d no population, e too little, z is not listed
    pop = spark.createDataFrame([(s, p) for s, p in zip("abcdefg", [900.0, 50.0, 1.0, None, 0.5, 70.0, 80.0])], "region string, population double")
    weeks = [monday + datetime.timedelta(weeks=k) for k in range(-2, 13)]  # before and after the panel too
    totals = spark.createDataFrame([(w, s, float(r.randrange(9)) * 1e5) for w in weeks for s in "abcdefgh"], "week date, wwtp string, total_out double")
    return records, pop, totals


@pytest.mark.parametrize("seed", [1, 2])
def test_export_risk_and_range(spark, seed):
    records, pop, totals = _inputs(spark, seed)
    whole, seen = panel.site_clinical(records, "case", pop, pop), panel.observed_site_clinical(records, "case", pop, pop)
    bounds, got = risk.pooled_clinical_range([whole]), risk.pooled_clinical_range([seen])
    assert tuple(got.first()) == pytest.approx(tuple(bounds.first()))
    assert seen.zeros().first()[0] + seen.rates().count() == whole.count()
    key = lambda df: sorted(map(str, (tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())))
    assert key(risk.export_risk(totals, seen, bounds)) == key(risk.export_risk(totals, whole, bounds))


def test_no_site_with_a_population(spark):
    records, pop, totals = _inputs(spark, 3)
    none = pop.withColumn("population", F.lit(0.5))
    seen = panel.observed_site_clinical(records, "case", none, none)
    assert tuple(risk.pooled_clinical_range([seen]).first()) == (0.0, 1.0)
    assert risk.export_risk(totals, seen, risk.pooled_clinical_range([seen])).count() == 0


def test_summary_builds_no_site_panel(spark, monkeypatch):
    """A row for each site, week and disease filled the disks."""
    monkeypatch.setattr(panel, "site_clinical", lambda *a, **k: pytest.fail("the whole panel is built"))
    assert catalog.QUERIES["R5_weekly_risk_summary"](spark, "/root/testdata/sf0.001").count() > 0
