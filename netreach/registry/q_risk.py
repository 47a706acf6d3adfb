"""Queries for clinical panels, risk and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from netreach.functions.keys import norm_disease
from netreach.operators import od, panel, quality, risk
from netreach.plans.staging import stage, stage_table
from netreach.registry.base import register
from netreach.registry.q_od import _YM
from netreach.registry.sqltables import TABLES
from netreach.sources import driver_tables as dt

TABLES["fx_weeks"] = """
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week
FROM (SELECT MIN(week) AS lo, MAX(week) AS hi FROM fx_clinical)"""
TABLES["fx_county_rate"] = """
SELECT d.disease, p.county_fips AS region, w.week, COALESCE(raw, 0) AS raw, p.population,
       CASE WHEN p.population >= 1 THEN COALESCE(raw, 0) / p.population * 1e5 END AS rate
FROM (SELECT 'COVID' AS disease UNION ALL SELECT 'Influenza' UNION ALL SELECT 'RSV') d
CROSS JOIN fx_population p CROSS JOIN (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week
  FROM (SELECT MIN(week) AS lo, MAX(week) AS hi FROM fx_clinical WHERE disease IS NOT NULL)) w
LEFT JOIN (SELECT disease, region, week, SUM(hospitalized) AS raw FROM fx_clinical WHERE disease IS NOT NULL GROUP BY 1, 2, 3) r
  ON r.disease = d.disease AND r.region = p.county_fips AND r.week = w.week"""
TABLES["fx_site_rate"] = """
SELECT d.disease, s.wwtp AS region, w.week, COALESCE(raw, 0) AS raw,
       CASE WHEN s.pop_served >= 1 THEN COALESCE(raw, 0) / s.pop_served * 1e5 END AS rate
FROM (SELECT DISTINCT disease FROM fx_site_clinical) d
CROSS JOIN (SELECT wwtp, pop_served FROM fx_sites WHERE pop_served >= 1) s CROSS JOIN (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week
  FROM (SELECT MIN(week) AS lo, MAX(week) AS hi FROM fx_site_clinical)) w
LEFT JOIN (SELECT disease, region, week, SUM(cases) AS raw FROM fx_site_clinical GROUP BY 1, 2, 3) r
  ON r.disease = d.disease AND r.region = s.wwtp AND r.week = w.week"""
TABLES["fx_range"] = """
SELECT quantile_cont(rate, 0.01) AS lo, quantile_cont(rate, 0.99) AS hi FROM
 (SELECT rate FROM fx_county_rate UNION ALL SELECT rate FROM fx_site_rate) WHERE rate IS NOT NULL"""
TABLES["fx_import"] = """
SELECT disease, week, wwtp, SUM((1 + c) * volume / (1500000.0 + 1e-9)) AS import_risk, SUM(volume) AS total_in,
  SUM(volume) / (1500000.0 + 1e-9) AS flow_in_norm, SUM(volume * c) / SUM(volume) AS clinical_norm,
  100.0 AS inflow_known_pct, 100 * COALESCE(SUM(CASE WHEN rate IS NOT NULL THEN volume END), 0) / SUM(volume) AS inflow_rated_pct,
  COALESCE(SUM(volume * rate), 0) / SUM(volume) AS county_rate_weighted
FROM (SELECT d.disease, e.week, e.wwtp, e.volume, r.rate,
   COALESCE(least(greatest((r.rate - lo) / (hi - lo + 1e-9), 0), 1), 0) AS c
  FROM fx_edges e CROSS JOIN (SELECT DISTINCT disease FROM fx_county_rate) d CROSS JOIN fx_range
  LEFT JOIN fx_county_rate r ON r.disease = d.disease AND r.region = e.county_fips AND r.week = e.week
  WHERE e.direction = 'county_to_wwtp') GROUP BY 1, 2, 3"""
TABLES["fx_outflow"] = """
SELECT week, wwtp, total_in, CASE WHEN s = 0 THEN total_in ELSE total_out END AS total_out
FROM (SELECT *, SUM(total_out) OVER (PARTITION BY week) AS s FROM fx_totals)"""
TABLES["fx_export"] = """
SELECT d.disease, t.week, t.wwtp, t.total_out, r.rate AS site_rate,
  (1 + CASE WHEN r.rate IS NOT NULL THEN least(greatest((r.rate - lo) / (hi - lo + 1e-9), 0), 1) END) * t.total_out / (1500000.0 + 1e-9) AS export_risk
FROM fx_outflow t CROSS JOIN (SELECT DISTINCT disease FROM fx_site_rate) d CROSS JOIN fx_range
LEFT JOIN fx_site_rate r ON r.disease = d.disease AND r.region = t.wwtp AND r.week = t.week"""
_D = ["covid", "influenza", "rsv"]
TABLES["fx_summary"] = (
    "SELECT t.week, t.wwtp, total_in, total_out, pop_served, i.* EXCLUDE (week, wwtp), e.* EXCLUDE (week, wwtp) FROM fx_outflow t "
    "LEFT JOIN fx_sites s ON t.wwtp = s.wwtp LEFT JOIN (SELECT week, wwtp, "
    + ", ".join(f"MAX(CASE WHEN lower(disease) = '{d}' THEN {c} END) AS {c}_{d}" for d in _D for c in ("import_risk", "clinical_norm", "county_rate_weighted"))
    + " FROM fx_import GROUP BY 1, 2) i ON t.week = i.week AND t.wwtp = i.wwtp LEFT JOIN (SELECT week, wwtp, "
    + ", ".join(f"MAX(CASE WHEN lower(disease) = '{d}' THEN {c} END) AS {c}_{d}" for d in _D for c in ("export_risk", "site_rate"))
    + " FROM fx_export GROUP BY 1, 2) e ON t.week = e.week AND t.wwtp = e.wwtp"
)


def county_pop(spark, sf):
    return dt.population(spark, sf).withColumnRenamed("county_fips", "region")


def site_pop(spark, sf):
    return dt.sites(spark, sf).select(F.col("wwtp").alias("region"), F.col("pop_served").alias("population"))


def county_rates(spark, sf):
    pop = county_pop(spark, sf)
    return panel.county_clinical(dt.clinical(spark, sf), "hosp", pop, pop)


def site_rates(spark, sf):
    pop = site_pop(spark, sf)
    return panel.site_clinical(dt.site_clinical(spark, sf), "case", pop, pop)


def observed_site_rates(spark, sf):
    pop = site_pop(spark, sf)
    return panel.observed_site_clinical(dt.site_clinical(spark, sf), "case", pop, pop)


def outflow(spark, sf):
    return od.ensure_outflow(od.weekly_totals(dt.weekly_edges(spark, sf)))


_RATE = "disease:s region:s week:d raw:f rate:f"


@register("C1_clinical_long", _RATE, "SELECT disease, region, week, raw, rate FROM fx_county_rate")
def _c1(spark, sf):
    return panel.clinical_long(dt.clinical(spark, sf), "county", "hosp", county_pop(spark, sf), county_pop(spark, sf))


@register(
    "C2_full_panel", "disease:s region:s week:d raw:f",
    """SELECT d.disease, p.county_fips AS region, w.week, COALESCE(raw, 0) AS raw FROM fx_population p CROSS JOIN fx_weeks w
       CROSS JOIN (SELECT DISTINCT disease FROM fx_clinical WHERE disease IS NOT NULL) d LEFT JOIN
       (SELECT disease, region, week, SUM(cases) AS raw FROM fx_clinical GROUP BY 1, 2, 3) r ON r.region = p.county_fips AND r.week = w.week AND r.disease = d.disease""",
)
def _c2(spark, sf):
    """Every county, week and listed pathogen."""
    rec = dt.clinical(spark, sf).select(
        norm_disease("pathogen").alias("disease"), "region", F.date_trunc("week", "event_date").cast("date").alias("week"), "cases")
    weekly = stage(rec.groupBy("disease", "region", "week").agg(F.sum("cases").alias("raw")))
    span = weekly.agg(F.min("week").cast("string"), F.max("week").cast("string")).first()
    diseases = weekly.filter(F.col("disease").isNotNull()).groupBy().agg(F.collect_set("disease").alias("_d"))  # listed names
    entities = county_pop(spark, sf).crossJoin(F.broadcast(diseases)).select("region", F.explode("_d").alias("disease"))
    return panel.full_panel(weekly, entities, ["raw"], keys=["disease"], start=span[0], end=span[1])


@register(
    "C3_drop_incomplete", _RATE, "SELECT disease, region, week, raw, rate FROM fx_site_rate",
)
def _c3(spark, sf):
    pop = site_pop(spark, sf)
    return panel.drop_incomplete(panel.clinical_long(dt.site_clinical(spark, sf), "sewershed", "case", pop, pop))


@register("C4_county_clinical", _RATE, "SELECT disease, region, week, raw, rate FROM fx_county_rate")
def _c4(spark, sf):
    return county_rates(spark, sf)


@register("C4_site_clinical", _RATE, "SELECT disease, region, week, raw, rate FROM fx_site_rate")
def _c4s(spark, sf):
    return site_rates(spark, sf)


@register(
    "C5_counts_by_age", "week:d region:s age_group:s hospitalized:f",
    "SELECT week, region, age_group, SUM(hospitalized) AS hospitalized FROM fx_clinical GROUP BY 1, 2, 3",
)
def _c5(spark, sf):
    return panel.counts_by_age(dt.clinical(spark, sf), "county")


@register(
    "C6_rates_weekly_to_monthly", "disease:s region:s year_month:s count:f rate:f",
    f"""SELECT disease, region, {_YM} AS year_month, SUM(rate * population / 1e5) AS count,
       SUM(rate * population / 1e5) / MAX(population) * 1e5 AS rate FROM fx_county_rate GROUP BY 1, 2, 3""",
)
def _c6(spark, sf):
    pop = county_pop(spark, sf)
    return panel.rates_weekly_to_monthly(panel.clinical_long(dt.clinical(spark, sf), "county", "hosp", pop, pop))


@register(
    "C7_rates_monthly_mean", "disease:s region:s year_month:s rate:f",
    f"SELECT disease, region, {_YM} AS year_month, AVG(rate) AS rate FROM fx_county_rate GROUP BY 1, 2, 3",
)
def _c7(spark, sf):
    return panel.rates_monthly_mean(county_rates(spark, sf))


@register(
    "C8_verify_panel", "entities:i weeks:i rows:i complete:b",
    """SELECT COUNT(DISTINCT disease || region) AS entities, COUNT(DISTINCT week) AS weeks, COUNT(*) AS rows,
       COUNT(*) = COUNT(DISTINCT disease || region) * COUNT(DISTINCT week) AS complete FROM fx_county_rate""",
)
def _c8(spark, sf):
    return panel.verify_panel(county_rates(spark, sf), keys=["disease"])


def _wide(spark, sf):
    return dt.clinical(spark, sf).groupBy(
        F.col("event_date").alias("day"), F.col("region").alias("county"), "pathogen"
    ).agg(F.sum("cases").alias("rate"), F.sum("hospitalized").alias("hosp_rate"))


TABLES["fx_wide"] = """
SELECT event_date AS day, week, region AS county, disease, SUM(cases) AS rate, SUM(hospitalized) AS hosp_rate
FROM fx_clinical GROUP BY 1, 2, 3, 4"""


@register("C9_county_rate_wide", "week:d county:s real:r", "SELECT week, county, AVG(rate) AS real FROM fx_wide GROUP BY 1, 2")
def _c9(spark, sf):
    return panel.county_rate_wide(_wide(spark, sf))


@register(
    "C10_flu_rsv_rates", "week:d county:s rate:r hosp_rate:r real:r norm:r",
    """SELECT *, rate AS real, least(greatest(rate, 0), 10) / 10 AS norm FROM (SELECT week, county, AVG(rate) AS rate,
       AVG(hosp_rate) AS hosp_rate FROM fx_wide WHERE disease = 'Influenza' GROUP BY 1, 2)""",
)
def _c10(spark, sf):
    return panel.flu_rsv_rates(_wide(spark, sf), "Influenza", ["rate", "hosp_rate"])


@register(
    "C11_viral_load", "week:d wwtp:s real:r norm:r",
    """SELECT *, least(greatest(real, 0), 10) / 10 AS norm FROM (
       SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(l_suppkey AS VARCHAR) AS wwtp, AVG(l_quantity / 4) AS real
       FROM lineitem GROUP BY 1, 2)""",
)
def _c11(spark, sf):
    li = dt.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("day"), F.col("l_suppkey").cast("string").alias("wwtp"), (F.col("l_quantity") / 4).alias("index"))
    return panel.viral_load(li, "wwtp")


@register(
    "C12_site_clinical_alloc", "week:d wwtp:s disease:s case_value:r hosp_value:r coverage_pct:r",
    """SELECT week, wwtp, disease, COALESCE(c, 0) AS case_value, COALESCE(h, c, 0) AS hosp_value, coverage_pct FROM (
       SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(l_suppkey AS VARCHAR) AS wwtp,
       CASE l_returnflag WHEN 'R' THEN 'RSV' WHEN 'A' THEN 'Influenza' ELSE 'COVID' END AS disease,
       AVG(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS c, AVG(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS h,
       AVG(l_discount) AS coverage_pct FROM lineitem GROUP BY 1, 2, 3)""",
)
def _c12(spark, sf):
    li = dt.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("week"), F.col("l_suppkey").cast("string").alias("wwtp"),
        F.when(F.col("l_returnflag") == "R", "rsv").when(F.col("l_returnflag") == "A", "flu").otherwise("SARS-CoV-2").alias("disease"),
        F.when(F.col("l_linestatus") == "F", "Case count").otherwise("Hospital cases").alias("metric"),
        F.col("l_quantity").alias("value"), F.col("l_discount").alias("coverage_pct"))
    out = panel.site_clinical_alloc(li, ["coverage_pct"])
    return out.withColumnsRenamed({"case": "case_value", "hosp": "hosp_value"})


@register(
    "C13_syndromic", "week:d county:s norm:r real:r",
    "SELECT week, county, least(greatest(real, 0), 10) / 10 AS norm, real FROM (SELECT week, county, AVG(rate) AS real FROM fx_wide WHERE disease = 'RSV' GROUP BY 1, 2)",
)
def _c13(spark, sf):
    return panel.syndromic(_wide(spark, sf), "RSV", ["rate"])


def bounds(spark, sf):
    return risk.pooled_clinical_range([county_rates(spark, sf), site_rates(spark, sf)])


def risk_inputs(spark, sf, edges=None):
    """Rates, edges (those staged before, if given) and the pooled range, each computed once and read by every later step."""
    c, s = stage(county_rates(spark, sf)), observed_site_rates(spark, sf)
    e = stage_table(dt.weekly_edges(spark, sf).select("week", "direction", "wwtp", "county_fips", "volume")) if edges is None else edges
    return c, s, e, stage(risk.pooled_clinical_range([c, s]))


@register("R1_pooled_clinical_range", "lo:f hi:f", "SELECT * FROM fx_range")
def _r1(spark, sf):
    return bounds(spark, sf)


def imports(spark, sf):
    c, _, e, b = risk_inputs(spark, sf)
    return risk.import_risk(e, c, county_pop(spark, sf), b)


@register(
    "R2_import_risk", "disease:s week:d wwtp:s import_risk:r county_rate_weighted:f",
    "SELECT disease, week, wwtp, import_risk, county_rate_weighted FROM fx_import",
)
def _r2(spark, sf):
    return imports(spark, sf)


@register(
    "R3_import_components",
    "disease:s week:d wwtp:s total_in:f flow_in_norm:r clinical_norm:r inflow_known_pct:f inflow_rated_pct:f",
    "SELECT * FROM fx_import",
)
def _r3(spark, sf):
    c, _, e, b = risk_inputs(spark, sf)
    return risk.import_components(e, c, county_pop(spark, sf), b)


def exports(spark, sf):
    _, s, e, b = risk_inputs(spark, sf)
    return risk.export_risk(od.ensure_outflow(od.weekly_totals(e)), s, b)


@register("R4_export_risk", "disease:s week:d wwtp:s total_out:f site_rate:f export_risk:r", "SELECT * FROM fx_export")
def _r4(spark, sf):
    return exports(spark, sf)


def summary(spark, sf, edges=None):
    c, s, e, b = risk_inputs(spark, sf, edges)
    t = od.ensure_outflow(od.weekly_totals(e))
    imp, exp = risk.import_risk(e, c, county_pop(spark, sf), b), risk.export_risk(t, s, b)
    return risk.weekly_risk_summary(t, dt.sites(spark, sf), imp, exp, ["COVID", "Influenza", "RSV"])


_SUM = "week:d wwtp:s total_in:f total_out:f pop_served:f " + " ".join(
    f"import_risk_{d}:r clinical_norm_{d}:r county_rate_weighted_{d}:f export_risk_{d}:r site_rate_{d}:f" for d in _D)


@register("R5_weekly_risk_summary", _SUM, "SELECT * FROM fx_summary")
def _r5(spark, sf):
    return summary(spark, sf)


@register(
    "R6_attach_trips", "week:d wwtp:s import_risk_covid:r total_in:f total_out:f total_flow:f net_flow:f",
    "SELECT *, total_in + total_out AS total_flow, total_out - total_in AS net_flow FROM fx_summary",
)
def _r6(spark, sf):
    return risk.attach_trips(summary(spark, sf), outflow(spark, sf))


TABLES["fx_risk_month"] = f"""
SELECT wwtp, {_YM} AS year_month, AVG(import_risk_covid) AS import_risk, AVG(export_risk_covid) AS export_risk,
  CASE WHEN AVG(import_risk_covid) IS NULL THEN AVG(export_risk_covid) WHEN AVG(export_risk_covid) IS NULL THEN AVG(import_risk_covid)
  ELSE (AVG(import_risk_covid) + AVG(export_risk_covid)) / 2 END AS combined_risk FROM fx_summary GROUP BY 1, 2"""


@register(
    "R7_monthly_risk_signal", "wwtp:s year_month:s import_risk:r export_risk:r combined_risk:r", "SELECT * FROM fx_risk_month"
)
def _r7(spark, sf):
    return risk.monthly_risk_signal(summary(spark, sf))


@register(
    "R8_monthly_components", "wwtp:s year:i month:i import_risk_covid:r export_risk_rsv:r total_in_mean:f total_out_max:f n_weeks:i",
    f"""SELECT a.wwtp, a.year, a.month, import_risk_covid, export_risk_rsv, total_in_mean, total_out_max, n_weeks FROM
     (SELECT wwtp, year(week) AS year, month(week) AS month, AVG(import_risk_covid) AS import_risk_covid, AVG(export_risk_rsv) AS export_risk_rsv
      FROM fx_summary GROUP BY 1, 2, 3) a JOIN
     (SELECT wwtp, year(week) AS year, month(week) AS month, AVG(total_in) AS total_in_mean, MAX(total_out) AS total_out_max,
      COUNT(DISTINCT week) AS n_weeks FROM fx_outflow GROUP BY 1, 2, 3) b ON a.wwtp = b.wwtp AND a.year = b.year AND a.month = b.month""",
)
def _r8(spark, sf):
    return risk.monthly_components(od.monthly_mean(summary(spark, sf)), od.monthly_trip_stats(outflow(spark, sf)))


@register(
    "Q1_duplicate_keys", "wwtp:s county_fips:s n:i",
    "SELECT wwtp, county_fips, COUNT(*) AS n FROM fx_edges GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def _q1(spark, sf):
    return quality.duplicate_keys(dt.weekly_edges(spark, sf), ["wwtp", "county_fips"])


@register(
    "Q2_reconcile", "rows:i failed:i one_sided:i max_abs_diff:f",
    """SELECT COUNT(*) AS rows, 0 AS failed, 0 AS one_sided, 0.0 AS max_abs_diff FROM
       (SELECT DISTINCT wwtp, strftime(week, '%Y-%m') AS ym FROM fx_edges WHERE direction = 'county_to_wwtp')""",
)
def _q2(spark, sf):
    e = dt.weekly_edges(spark, sf)
    inbound = od.weekly_totals(e.filter(F.col("direction") == od.INBOUND))
    total = inbound.groupBy("wwtp", F.date_format("week", "yyyy-MM").alias("year_month")).agg(F.avg("total_in").alias("total"))
    d = quality.reconcile(od.county_monthly(e, od.INBOUND), total, ["wwtp", "year_month"], "volume_mean", "total")
    return quality.reconcile_summary(d)


@register(
    "Q3_monthly_consistency", "table_name:s missing:i extra:i max_abs_diff:f ok:b",
    "SELECT 'means' AS table_name, 0 AS missing, 0 AS extra, 0.0 AS max_abs_diff, COUNT(*) >= 0 AS ok FROM fx_totals",
)
def _q3(spark, sf):
    t = outflow(spark, sf)
    a = od.monthly_trip_stats(t).select("wwtp", "year", "month", F.col("total_in_mean").alias("total_in"), F.col("total_out_mean").alias("total_out"))
    b = od.monthly_mean(t)
    return quality.monthly_consistency({"trips": a, "means": b}, ["wwtp", "year", "month"], ["total_in", "total_out"])
