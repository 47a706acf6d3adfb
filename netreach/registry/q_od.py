"""Queries for keys, periods and OD aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netreach.operators import od
from netreach.registry.base import register
from netreach.sources import driver_tables as dt

_M = "volume:f area:f population:f"


@register("A1_weekly_od", f"week:d direction:s wwtp:s county_fips:s {_M}", "SELECT * FROM fx_edges")
def _a1(spark, sf):
    return od.weekly_od(dt.daily_od(spark, sf))


@register(
    "A2_weekly_cases", "region:s week:d rate:r",
    """SELECT region, week, AVG(rate) AS rate FROM (
       SELECT region, week, event_date, SUM(cases) AS rate FROM fx_clinical GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _a2(spark, sf):
    daily = dt.clinical(spark, sf).groupBy("region", F.col("event_date").alias("day")).agg(F.sum("cases").alias("rate"))
    return od.weekly_cases(daily, "region")


@register(
    "A3_collapse_edges", f"week:d direction:s wwtp:s county_fips:s {_M}",
    """SELECT CAST(date_trunc('week', day) AS DATE) AS week, direction, site AS wwtp, county AS county_fips,
       SUM(volume) AS volume, SUM(area) AS area, SUM(population) AS population FROM fx_trips GROUP BY 1, 2, 3, 4""",
)
def _a3(spark, sf):
    t = dt._trips(spark, sf).select(
        F.date_trunc("week", "day").cast("date").alias("week"), "direction",
        F.col("site").alias("wwtp"), F.col("county").alias("county_fips"), "volume", "area", "population",
    )
    return od.collapse_edges(t)


_TOT = "week:d wwtp:s total_in:f total_out:f total_flow:f net_flow:f"


@register("A4_weekly_totals", _TOT, "SELECT * FROM fx_totals")
def _a4(spark, sf):
    return od.weekly_totals(dt.weekly_edges(spark, sf))


_OUTLESS = """SELECT week, wwtp, total_in, CASE WHEN week < DATE '1997-01-01' THEN 0 ELSE total_out END AS total_out FROM fx_totals"""


@register(
    "A5_ensure_outflow", _TOT + " outflow_source:s",
    f"""SELECT week, wwtp, total_in, o AS total_out, total_in + o AS total_flow, o - total_in AS net_flow, outflow_source
    FROM (SELECT *, CASE WHEN s = 0 THEN total_in ELSE total_out END AS o,
          CASE WHEN s = 0 THEN 'inflow_copy' ELSE 'observed' END AS outflow_source
          FROM (SELECT *, SUM(total_out) OVER (PARTITION BY week) AS s FROM ({_OUTLESS})))""",
)
def _a5(spark, sf):
    t = od.weekly_totals(dt.weekly_edges(spark, sf))
    early = F.col("week") < F.lit("1997-01-01").cast("date")
    return od.ensure_outflow(t.withColumn("total_out", F.when(early, 0.0).otherwise(F.col("total_out"))))


@register(
    "A6_weekly_trip_table", "week:d inbound:f outbound:f cells:i zero_in:i",
    """SELECT week, SUM(inbound) AS inbound, SUM(outbound) AS outbound, COUNT(*) AS cells,
       SUM(CASE WHEN inbound = 0 THEN 1 ELSE 0 END) AS zero_in FROM (
       SELECT g.week, g.wwtp, g.county_fips,
         COALESCE(SUM(CASE WHEN direction = 'county_to_wwtp' THEN volume END), 0) AS inbound,
         COALESCE(SUM(CASE WHEN direction = 'wwtp_to_county' THEN volume END), 0) AS outbound
       FROM (SELECT a.wwtp, week, county_fips FROM (SELECT DISTINCT wwtp, week FROM fx_edges) a
             JOIN (SELECT DISTINCT wwtp, county_fips FROM fx_edges) b ON a.wwtp = b.wwtp) g
       LEFT JOIN fx_edges e ON g.week = e.week AND g.wwtp = e.wwtp AND g.county_fips = e.county_fips
       GROUP BY 1, 2, 3) GROUP BY week""",
)
def _a6(spark, sf):
    dense = od.weekly_trip_tables(dt.weekly_edges(spark, sf))[1]
    return dense.groupBy("week").agg(
        F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"),
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("inbound") == 0).alias("zero_in"),
    )


_SPREAD = " ".join(f"total_{m}_{s}:f" for m in ("in", "out", "flow") for s in ("mean", "min", "max"))
_SPREAD_SQL = ", ".join(
    f"{f}(total_{m}) AS total_{m}_{s}"
    for m in ("in", "out", "flow") for f, s in (("AVG", "mean"), ("MIN", "min"), ("MAX", "max"))
)
_YM = "strftime(week, '%Y-%m')"
_SEASON = ("CASE WHEN month(week) IN (12, 1, 2) THEN 'Winter' WHEN month(week) IN (3, 4, 5) THEN 'Spring' "
           "WHEN month(week) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END")
_SYEAR = "(year(week) + CASE WHEN month(week) = 12 THEN 1 ELSE 0 END)"
_YS = f"CAST({_SYEAR} AS VARCHAR) || '-' || {_SEASON}"
_YQ = "CAST(year(week) AS VARCHAR) || '-Q' || CAST(quarter(week) AS VARCHAR)"
_Y = "CAST(year(week) AS VARCHAR)"


@register(
    "A7_period_stats", f"wwtp:s grain:s period:s {_SPREAD} n_weeks:i",
    " UNION ALL ".join(
        f"SELECT wwtp, '{g}' AS grain, {e} AS period, {_SPREAD_SQL}, COUNT(DISTINCT week) AS n_weeks FROM fx_totals GROUP BY wwtp, {e}"
        for g, e in (("month", _YM), ("quarter", _YQ), ("season", _YS), ("year", _Y))
    ),
)
def _a7(spark, sf):
    return od.all_period_stats(od.weekly_totals(dt.weekly_edges(spark, sf)))


@register(
    "A7_period_stats_season", f"wwtp:s period:s {_SPREAD} n_weeks:i",
    f"SELECT wwtp, {_YS} AS period, {_SPREAD_SQL}, COUNT(DISTINCT week) AS n_weeks FROM fx_totals GROUP BY 1, 2",
)
def _a7s(spark, sf):
    return od.period_stats(od.weekly_totals(dt.weekly_edges(spark, sf)), "season")


_IO = " ".join(f"total_{m}_{s}:f" for m in ("in", "out") for s in ("mean", "min", "max"))


@register(
    "A8_monthly_trip_stats", f"wwtp:s year:i month:i {_IO} n_weeks:i",
    f"SELECT wwtp, year(week) AS year, month(week) AS month, {_SPREAD_SQL}, COUNT(DISTINCT week) AS n_weeks FROM fx_totals GROUP BY 1, 2, 3",
)
def _a8(spark, sf):
    return od.monthly_trip_stats(od.weekly_totals(dt.weekly_edges(spark, sf)))


@register(
    "A9_monthly_mean", "wwtp:s year:i month:i total_in:f total_out:f total_flow:f net_flow:f",
    """SELECT wwtp, year(week) AS year, month(week) AS month, AVG(total_in) AS total_in, AVG(total_out) AS total_out,
       AVG(total_flow) AS total_flow, AVG(net_flow) AS net_flow FROM fx_totals GROUP BY 1, 2, 3""",
)
def _a9(spark, sf):
    return od.monthly_mean(od.weekly_totals(dt.weekly_edges(spark, sf)))


_GRID = """SELECT g.direction, g.wwtp, g.county_fips, g.week, COALESCE(volume, 0) AS volume, area, population FROM
  (SELECT a.direction, a.wwtp, county_fips, week FROM (SELECT DISTINCT direction, wwtp, week FROM fx_edges) a
   JOIN (SELECT DISTINCT direction, wwtp, county_fips FROM fx_edges) b ON a.direction = b.direction AND a.wwtp = b.wwtp) g
  LEFT JOIN fx_edges e ON g.direction = e.direction AND g.wwtp = e.wwtp AND g.county_fips = e.county_fips AND g.week = e.week"""


@register(
    "A10_complete_grid", "direction:s wwtp:s cells:i gaps:i volume:f area:f",
    f"""SELECT direction, wwtp, COUNT(*) AS cells, SUM(CASE WHEN area IS NULL THEN 1 ELSE 0 END) AS gaps,
        SUM(volume) AS volume, SUM(area) AS area FROM ({_GRID}) GROUP BY 1, 2""",
)
def _a10(spark, sf):
    g = od.complete_grid(dt.weekly_edges(spark, sf))
    return g.groupBy("direction", "wwtp").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("area").isNull()).alias("gaps"),
        F.sum("volume").alias("volume"), F.sum("area").alias("area"),
    )


def _monthly_sql(direction: str) -> str:
    return f"""SELECT wwtp, county_fips, {_YM} AS year_month, AVG(volume) AS volume_mean, MIN(volume) AS volume_min,
      MAX(volume) AS volume_max, COUNT(DISTINCT week) AS n_weeks FROM ({_GRID}) WHERE direction = '{direction}' GROUP BY 1, 2, 3"""


_CM = "wwtp:s county_fips:s year_month:s volume_mean:f volume_min:f volume_max:f n_weeks:i"


@register("A11_county_monthly", _CM, _monthly_sql("county_to_wwtp"))
def _a11(spark, sf):
    return od.county_monthly(dt.weekly_edges(spark, sf), od.INBOUND)


_BOTH = " ".join(f"{t}_volume_{s}:f" for t in ("in", "out") for s in ("mean", "min", "max"))


@register(
    "A12_combine_directions", f"wwtp:s county_fips:s year_month:s {_BOTH} in_n_weeks:i out_n_weeks:i",
    "SELECT COALESCE(i.wwtp, o.wwtp) AS wwtp, COALESCE(i.county_fips, o.county_fips) AS county_fips, "
    "COALESCE(i.year_month, o.year_month) AS year_month, "
    + ", ".join(f"COALESCE({t[0]}.volume_{s}, 0) AS {t}_volume_{s}" for t in ("in", "out") for s in ("mean", "min", "max"))
    + ", COALESCE(i.n_weeks, 0) AS in_n_weeks, COALESCE(o.n_weeks, 0) AS out_n_weeks "
    + f"FROM ({_monthly_sql('county_to_wwtp')}) i FULL JOIN ({_monthly_sql('wwtp_to_county')}) o "
    + "ON i.wwtp = o.wwtp AND i.county_fips = o.county_fips AND i.year_month = o.year_month",
)
def _a12(spark, sf):
    e = dt.weekly_edges(spark, sf)
    return od.combine_directions(od.county_monthly(e, od.INBOUND), od.county_monthly(e, od.OUTBOUND))


@register(
    "A13_county_sources_monthly", _CM,
    f"""SELECT c.wwtp, c.county_fips, c.ym AS year_month, s / n_weeks AS volume_mean,
     CASE WHEN n < n_weeks THEN 0 ELSE lo END AS volume_min, hi AS volume_max, n_weeks FROM
     (SELECT wwtp, county_fips, {_YM} AS ym, SUM(volume) AS s, MIN(volume) AS lo, MAX(volume) AS hi, COUNT(*) AS n
      FROM fx_edges WHERE direction = 'county_to_wwtp' GROUP BY 1, 2, 3) c JOIN
     (SELECT wwtp, {_YM} AS ym, COUNT(DISTINCT week) AS n_weeks FROM fx_edges WHERE direction = 'county_to_wwtp' GROUP BY 1, 2) m
     ON c.wwtp = m.wwtp AND c.ym = m.ym WHERE s <> 0""",
)
def _a13(spark, sf):
    return od.county_sources_monthly(dt.weekly_edges(spark, sf), od.INBOUND)


@register(
    "A14_yoy_monthly", "wwtp:s year:i month:i total_in:f total_out:f total_flow:f n_weeks:i n_years:i",
    """SELECT m.*, n_years FROM (SELECT wwtp, year(week) AS year, month(week) AS month, AVG(total_in) AS total_in,
       AVG(total_out) AS total_out, AVG(total_flow) AS total_flow, COUNT(DISTINCT week) AS n_weeks FROM fx_totals GROUP BY 1, 2, 3) m
       JOIN (SELECT wwtp, COUNT(DISTINCT year(week)) AS n_years FROM fx_totals GROUP BY 1 HAVING COUNT(DISTINCT year(week)) >= 2) y
       ON m.wwtp = y.wwtp""",
)
def _a14(spark, sf):
    return od.yoy_monthly(od.weekly_totals(dt.weekly_edges(spark, sf)), ["total_in", "total_out", "total_flow"])


@register("A15_match_target", "matched:s", "SELECT MIN(s_name) AS matched FROM supplier WHERE lower(s_name) = 'supplier#000000003'")
def _a15(spark, sf):
    return od.match_target(dt.table(spark, sf, "supplier"), "s_name", " supplier#000000003 ")


_FLOW = """SELECT week, CASE WHEN direction = 'county_to_wwtp' THEN 'C_' || county_fips ELSE 'W_' || wwtp END AS src,
  CASE WHEN direction = 'county_to_wwtp' THEN 'W_' || wwtp ELSE 'C_' || county_fips END AS dst, volume AS w FROM fx_edges"""


#: How many nodes the bipartite flow has.
_NODES = "SELECT (SELECT COUNT(DISTINCT county_fips) FROM fx_edges) + (SELECT COUNT(DISTINCT wwtp) FROM fx_edges) AS n"


def flow_stats_sql(flow: str, key: str, nodes: str = _NODES) -> str:
    return f"""SELECT {key + ',' if key else ''} SUM(k) * 100.0 / (MIN(n) * MIN(n) - MIN(n)) AS density_pct,
      sqrt(greatest(SUM(s2) / (MIN(n) * MIN(n) - MIN(n)) - (SUM(s1) / (MIN(n) * MIN(n) - MIN(n))) * (SUM(s1) / (MIN(n) * MIN(n) - MIN(n))), 0)) AS std_flow,
      SUM(CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END) / MIN(n) AS mean_entropy, SUM(k) AS nnz
      FROM (SELECT {key + ',' if key else ''} src, SUM(-p * ln(p)) AS h, COUNT(*) AS k, SUM(p * p) AS s2, SUM(p) AS s1 FROM
        (SELECT {key + ',' if key else ''} src, w / SUM(w) OVER (PARTITION BY {key + ',' if key else ''} src) AS p FROM
         (SELECT {key + ',' if key else ''} src, dst, SUM(w) AS w FROM ({flow}) WHERE src <> dst AND w > 0 GROUP BY {key + ',' if key else ''} src, dst))
        GROUP BY {key + ',' if key else ''} src),
      ({nodes})
      {'GROUP BY ' + key if key else ''}"""


def _flows(edges):
    inb = F.col("direction") == od.INBOUND
    c, w = F.concat(F.lit("C_"), "county_fips"), F.concat(F.lit("W_"), "wwtp")
    return edges.select("week", F.when(inb, c).otherwise(w).alias("src"), F.when(inb, w).otherwise(c).alias("dst"),
                        F.col("volume").alias("w"))


def _n_nodes(edges):
    return edges.agg((F.count_distinct("county_fips") + F.count_distinct("wwtp")).alias("n"))


_FS = "density_pct:r std_flow:r mean_entropy:r nnz:i"


@register("A16_od_flow_stats", "week:d " + _FS, flow_stats_sql(_FLOW, "week"))
def _a16(spark, sf):
    e = dt.weekly_edges(spark, sf)
    return od.od_flow_stats(_flows(e), _n_nodes(e))


@register("A16_od_flow_stats_window", _FS, flow_stats_sql(_FLOW, ""))
def _a16w(spark, sf):
    e = dt.weekly_edges(spark, sf)
    return od.od_flow_stats(_flows(e), _n_nodes(e), None)


@register(
    "A17_flow_per_capita", "week:d wwtp:s total_flow:f pop_served:f flow_per_capita:r",
    """SELECT week, t.wwtp, total_flow, pop_served, total_flow / NULLIF(pop_served, 0) AS flow_per_capita
       FROM fx_totals t LEFT JOIN fx_sites s ON t.wwtp = s.wwtp""",
)
def _a17(spark, sf):
    return od.flow_per_capita(od.weekly_totals(dt.weekly_edges(spark, sf)), dt.sites(spark, sf))
