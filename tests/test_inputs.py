"""Keys, periods and readers on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from netreach.functions import keys, periods
from netreach.functions.expr import num
from netreach.operators import od, panel, quality, risk
from netreach.sources import readers, sinks


def col(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(expr).collect()]


def test_keys(spark):
    assert col(spark, ["8001.0", " 08013 ", "123456", None, ""], keys.canon_county("c")) == ["08001", "08013", "123456", None, None]
    assert col(spark, [" Big  Town "], keys.canon_site("c", squeeze=True)) == ["big town"]
    assert col(spark, ["80010001001"], keys.area_county("c")) == ["08001"]
    assert col(spark, ["abc", "nan", "2.5"], num("c")) == [None, None, 2.5]
    assert col(spark, ["Adams County", "St. Mary Parish"], keys.strip_county_suffix("c")) == ["Adams", "St. Mary"]
    df = spark.createDataFrame([("Old HISTORIC plant",), ("new",), (None,)], "w string")
    assert keys.drop_historic(df, "w").count() == 2


def test_periods(spark):
    assert col(spark, ["2024-12-31", "x"], periods.to_monday("c")) == [dt.date(2024, 12, 30), None]
    df = spark.createDataFrame([(dt.date(2024, 12, 2),), (dt.date(2025, 1, 6),)], "week date")
    got = {r.week: r.year_season for r in periods.add_period_fields(df).collect()}
    assert set(got.values()) == {"2025-Winter"}
    w = periods.month_windows(spark, "2024-01-15", "2024-03-01").orderBy("label").collect()
    assert [r.label for r in w] == ["2024-01", "2024-02", "2024-03"] and w[1].last_day == dt.date(2024, 2, 29)
    with pytest.raises(ValueError):
        periods.in_window(df, "2025-01-01", "2024-01-01")


def test_daily_files(spark, tmp_path):
    head = "direction,Sewershed-O,Sewershed-D,County,Volume,Area,Population\n"
    (tmp_path / "od_20240101.csv").write_text(head + "Destination,, Town A ,8001.0,10,1,5\nOrigin,Town A,,8003,bad,2,nan\n")
    (tmp_path / "od_20240103.csv").write_text(head + "Destination,,TOWN A,8001,20,3,5\n")
    (tmp_path / "od_latest.csv").write_text(head + "Destination,,TOWN A,8001,999,3,5\n")
    daily = readers.read_daily_od(spark, str(tmp_path))
    assert daily.count() == 3 and readers.skipped_files(spark, str(tmp_path)).count() == 1
    week = {(r.direction, r.county_fips): (r.volume, r.area) for r in od.weekly_od(daily).collect()}
    assert week[(od.INBOUND, "08001")] == (15.0, 2.0)  # a missing day is not a zero
    assert week[(od.OUTBOUND, "08003")] == (None, 2.0)


def edge_rows(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 29)]
    rows = [
        (d[0], od.INBOUND, "a", "00001", 4.0, 1.0, 1.0), (d[0], od.OUTBOUND, "a", "00001", 2.0, 1.0, 1.0),
        (d[1], od.INBOUND, "a", "00002", 6.0, 1.0, 1.0), (d[2], od.INBOUND, "a", "00001", 8.0, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, "week date, direction string, wwtp string, county_fips string, volume double, area double, population double")


def test_flow_tables(spark):
    e = edge_rows(spark)
    t = {r.week.day: (r.total_out, r.outflow_source) for r in od.ensure_outflow(od.weekly_totals(e)).collect()}
    assert t == {1: (2.0, "observed"), 8: (6.0, "inflow_copy"), 29: (8.0, "inflow_copy")}
    m = {r.county_fips: (r.volume_mean, r.volume_min, r.volume_max, r.n_weeks) for r in od.county_monthly(e, od.INBOUND).collect()}
    assert m == {"00001": (4.0, 0.0, 8.0, 3), "00002": (2.0, 0.0, 6.0, 3)}
    assert od.complete_grid(e).filter(F.col("direction") == od.INBOUND).count() == 6
    names = spark.createDataFrame([("Alpha North",), ("Alpha South",), ("Beta",)], "s string")
    assert od.match_target(names, "s", "bet").first()[0] == "Beta"
    assert od.match_target(names, "s", "alpha").first()[0] is None


def test_risk_edges(spark):
    e = edge_rows(spark)
    rates = spark.createDataFrame([("COVID", "00001", dt.date(2024, 1, 1), 5.0)], "disease string, region string, week date, rate double")
    known = spark.createDataFrame([("00001",)], "region string")
    b = spark.createDataFrame([(0.0, 10.0)], "lo double, hi double")
    got = {r.week.day: r.import_risk for r in risk.import_risk(e, rates, known, b).collect()}
    assert got[1] == pytest.approx(1.5 * 4 / 1.5e6)
    assert got[8] == 0.0  # county outside the layer drops out
    assert got[29] == pytest.approx(8 / 1.5e6)  # known county without a rate
    with pytest.raises(Exception, match="no trip totals"):
        bad = spark.createDataFrame([("zz", dt.date(2024, 1, 1), 1.0)], "wwtp string, week date, r double")
        risk.attach_trips(bad, od.weekly_totals(e)).collect()


def test_panel_and_gates(spark):
    rec = spark.createDataFrame(
        [("County", "00001", "covid-19", dt.date(2024, 1, 3), 2.0, 1.0), ("county", "00001", "COVID", dt.date(2024, 1, 16), 1.0, 0.0),
         ("county", "00002", "RSV", dt.date(2024, 1, 9), 4.0, 0.0)],
        "region_level string, region string, pathogen string, event_date date, cases double, hospitalized double")
    pop = spark.createDataFrame([("00001", 1000.0), ("00002", 0.0)], "region string, population double")
    p = panel.clinical_long(rec, "county", "case", pop, pop)
    assert p.count() == 2 * 2 * 3
    panel.assert_panel(p, keys=["disease"])
    kept = panel.drop_incomplete(p)
    assert {r.region for r in kept.select("region").distinct().collect()} == {"00001"}
    with pytest.raises(ValueError):
        quality.assert_unique(p, ["region"])
    diff = quality.reconcile(
        spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double"), spark.createDataFrame([("a", 3.5)], "k string, t double"), ["k"], "v", "t")
    with pytest.raises(ValueError):
        quality.assert_reconciled(diff)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "wwtp string, v double")
    listed = sinks.write_table(df, str(tmp_path / "t"), "wwtp")
    paths = {r.wwtp: r.path for r in listed.collect()}
    assert spark.read.parquet(paths["a"]).count() == 2
    m = spark.createDataFrame([("x", 0.0, 2.0), ("y", 1.0, 0.0)], "node string, x double, y double")
    e = sinks.matrix_to_edges(m)
    assert {(r.src, r.dst, r.value) for r in e.collect()} == {("x", "y", 2.0), ("y", "x", 1.0)}
    assert sorted(map(tuple, sinks.edges_to_matrix(e, ["x", "y"]).collect())) == [("x", 0.0, 2.0), ("y", 1.0, 0.0)]


def test_losses_are_counted_in_the_same_pass(spark, tmp_path):
    folder = tmp_path / "od"
    folder.mkdir()
    head = "direction,Sewershed-O,Sewershed-D,County,Volume,Area,Population\n"
    (folder / "od_20240108.csv").write_text(head + "Destination,,p1,1,5,1,1\nsideways,,p1,1,5,1,1\nOrigin,,p1,1,x,1,1\n")
    (folder / "od_notes.csv").write_text(head + "Destination,,p1,1,5,1,1\nDestination,,p1,1,5,1,1\n")
    read, week = Observation("read"), Observation("week")
    weekly = od.weekly_od(readers.read_daily_od(spark, str(folder), read), week)
    assert weekly.count() == 1
    assert read.get == {"rows": 5, "undated": 2, "unread_volume": 1}
    assert week.get["rows"] == 3 and week.get["no_direction"] == 1 and week.get["no_wwtp"] == 2


def test_clinical_file(spark, tmp_path):
    path = str(tmp_path / "cases.csv")
    with open(path, "w") as f:
        f.write("Region Level,Region Name,Pathogen Name,Date,Cases\n")
        f.write("County,  EL PASO county ,COVID,1/9/2024,3\nCounty,041,COVID,2024-01-10 00:00:00,many\nCounty,Atlantis,RSV,2024/1/11,1\nSewershed, Plant A,RSV,someday,2\n")
    losses, lost = Observation("clinical"), Observation("regions")
    rec = readers.read_clinical(spark, path, ("cases",), losses)
    names = spark.createDataFrame([("08041", "El Paso County"), ("00041", "Other")], "county_fips string, county_name string")
    got = [(x.region, str(x.event_date), x.cases, x.hospitalized) for x in readers.canonical_regions(rec, names, lost).collect()]
    assert sorted(got) == [("00041", "2024-01-10", None, None), ("08041", "2024-01-09", 3.0, None), ("Plant A", "None", 2.0, None)]
    assert losses.get == {"rows": 4, "undated": 1, "unread_cases": 1} and lost.get == {"rows": 4, "unknown_region": 1}
    with pytest.raises(ValueError):
        readers.read_clinical(spark, path, ("hospitalized",))


def test_disease_labels(spark):
    given = ["Group A - x", "a/b", "(b", "type_3b", " FLU ", "sars cov 2", "o'neil"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, d string")
    got = [x[0] for x in rows.orderBy("i").select(keys.norm_disease("d")).collect()]
    assert got == [g.strip().title() for g in given[:4]] + ["Influenza", "COVID", "O'Neil"]
