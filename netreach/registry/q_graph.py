"""Queries for the site graph, rankings and coverage curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from netreach.operators import coverage as cov
from netreach.operators import graph, ranking
from netreach.plans.staging import stage, stage_table
from netreach.registry.base import register
from netreach.registry.q_od import _YM
from netreach.registry.q_risk import summary
from netreach.registry.sqltables import TABLES
from netreach.operators.risk import monthly_risk_signal
from netreach.sources import driver_tables as dt

M = graph.METRICS

TABLES["fx_half_edges"] = """
SELECT a.wwtp AS u, b.wwtp AS v FROM fx_sites a JOIN fx_sites b ON a.wwtp < b.wwtp
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.radius / 2 + b.radius / 2) * (a.radius / 2 + b.radius / 2)"""
TABLES["fx_components"] = """
SELECT wwtp, component, COUNT(*) OVER (PARTITION BY component) AS component_size FROM (
 WITH RECURSIVE reach(wwtp, r) AS (SELECT wwtp, wwtp FROM fx_sites UNION
   SELECT e.b, reach.r FROM reach JOIN (SELECT u AS a, v AS b FROM fx_half_edges UNION ALL SELECT v, u FROM fx_half_edges) e ON reach.wwtp = e.a)
 SELECT wwtp, MIN(r) AS component FROM reach GROUP BY wwtp)"""
TABLES["fx_nearest"] = """
SELECT a.wwtp, MIN(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nearest_km
FROM fx_sites a JOIN fx_sites b ON a.wwtp <> b.wwtp GROUP BY 1"""


def _cov_sql(by: str) -> str:
    g = f"{by} AS year_month, " if by else ""
    parts = ", ".join(
        f"COALESCE(SUM(CASE WHEN direction = '{d}' THEN {m} END), 0) AS {m}_{t}"
        for m in ("volume", "area", "population") for t, d in (("in", "county_to_wwtp"), ("out", "wwtp_to_county"))
    )
    n = ", ".join(f"COUNT(DISTINCT CASE WHEN direction = '{d}' THEN county_fips END) AS n_counties_{t}"
                  for t, d in (("in", "county_to_wwtp"), ("out", "wwtp_to_county")))
    return (f"SELECT *, volume_in + volume_out AS od_volume_total, area_in + area_out AS area_reached, "
            f"population_in + population_out AS pop_covered_by_od FROM (SELECT {g} wwtp, {parts}, {n} FROM fx_edges GROUP BY {by + ',' if by else ''} wwtp)")


TABLES["fx_coverage"] = _cov_sql("")
TABLES["fx_coverage_month"] = _cov_sql(_YM)
TABLES["fx_features"] = """
SELECT s.wwtp, pop_served, COALESCE(od_volume_total, 0) AS od_volume_total, COALESCE(pop_covered_by_od, 0) AS pop_covered_by_od,
 COALESCE(area_reached, 0) AS area_reached FROM fx_sites s LEFT JOIN fx_coverage c ON s.wwtp = c.wwtp"""
TABLES["fx_features_month"] = """
SELECT m.year_month, s.wwtp, pop_served, COALESCE(od_volume_total, 0) AS od_volume_total, COALESCE(pop_covered_by_od, 0) AS pop_covered_by_od,
 COALESCE(area_reached, 0) AS area_reached FROM fx_sites s CROSS JOIN (SELECT DISTINCT year_month FROM fx_coverage_month) m
 LEFT JOIN fx_coverage_month c ON s.wwtp = c.wwtp AND c.year_month = m.year_month"""
_RANKS = ", ".join(f"rank() OVER (ORDER BY ROUND({m}, 6) DESC) AS rank_{m}" for m in M)
_RANKS_MONTH = ", ".join(f"rank() OVER (PARTITION BY year_month ORDER BY ROUND({m}, 6) DESC) AS rank_{m}" for m in M)
_RSUM = " + ".join(f"rank_{m}" for m in M)
TABLES["fx_ranks"] = f"SELECT *, ({_RSUM}) / 4.0 AS final_rank FROM (SELECT *, {_RANKS} FROM fx_features)"
TABLES["fx_ranks_month"] = f"SELECT *, ({_RSUM}) / 4.0 AS final_rank FROM (SELECT *, {_RANKS_MONTH} FROM fx_features_month)"
TABLES["fx_order"] = """SELECT 'level1' AS strategy, row_number() OVER (ORDER BY final_rank, wwtp) AS ord, wwtp FROM fx_ranks"""
TABLES["fx_orders"] = """
SELECT 'population' AS strategy, row_number() OVER (ORDER BY ROUND(pop_served, 6) DESC, wwtp) AS ord, wwtp FROM fx_features
UNION ALL SELECT 'mobility', row_number() OVER (ORDER BY ROUND(od_volume_total, 6) DESC, wwtp), wwtp FROM fx_features
UNION ALL SELECT * FROM fx_order"""


def half_sites(spark, sf):
    """Sites with halved radii, so that the graph has isolated sites and small groups."""
    return dt.sites(spark, sf).withColumn("radius", F.col("radius") / 2)


def features(spark, sf):
    return stage(graph.feature_table(dt.sites(spark, sf), graph.od_coverage(dt.weekly_edges(spark, sf))))


def month_coverage(spark, sf, edges=None):
    e = (dt.weekly_edges(spark, sf) if edges is None else edges).withColumn("year_month", F.date_format("week", "yyyy-MM"))
    return graph.od_coverage(e, ["year_month"])


def month_features(spark, sf, edges=None):
    return stage(graph.feature_table(dt.sites(spark, sf), stage(month_coverage(spark, sf, edges)), ["year_month"]))


def level1_order(feats):
    o = ranking.order_by_rank(ranking.month_rank_table(feats))
    return o.select(F.lit("level1").alias("strategy"), "ord", "wwtp")


def orders(feats):
    return stage(cov.as_order(feats, "population", "pop_served").unionByName(cov.as_order(feats, "mobility", "od_volume_total"))
                 .unionByName(level1_order(feats)))


@register(
    "N1_site_edges", "u:s v:s",
    """SELECT a.wwtp AS u, b.wwtp AS v FROM fx_sites a JOIN fx_sites b ON a.wwtp < b.wwtp
       AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.radius + b.radius) * (a.radius + b.radius)""",
)
def _n1(spark, sf):
    return graph.site_edges(dt.sites(spark, sf))


@register("N2_components", "wwtp:s component:s component_size:i", "SELECT * FROM fx_components")
def _n2(spark, sf):
    s = half_sites(spark, sf)
    return graph.components(s, graph.component_edges(s))


@register("N3_nearest_other", "wwtp:s nearest_km:r", "SELECT * FROM fx_nearest")
def _n3(spark, sf):
    return graph.nearest_other(dt.sites(spark, sf))


@register(
    "N4_degree_centrality", "wwtp:s degree:i centrality:r",
    """SELECT s.wwtp, COUNT(e.u) AS degree, COUNT(e.u) / CAST((SELECT COUNT(*) - 1 FROM fx_sites) AS DOUBLE) AS centrality
       FROM fx_sites s LEFT JOIN fx_half_edges e ON s.wwtp = e.u OR s.wwtp = e.v GROUP BY 1""",
)
def _n4(spark, sf):
    s = half_sites(spark, sf)
    return graph.degree_centrality(s, graph.site_edges(s))


_COV = " ".join(f"{m}_{t}:f" for m in ("volume", "area", "population") for t in ("in", "out"))


@register(
    "N5_od_coverage", f"wwtp:s {_COV} n_counties_in:i n_counties_out:i od_volume_total:f area_reached:f pop_covered_by_od:f",
    "SELECT * FROM fx_coverage",
)
def _n5(spark, sf):
    c = graph.od_coverage(dt.weekly_edges(spark, sf))
    return c.withColumns({f"n_counties_{t}": F.size(f"counties_{t}") for t in ("in", "out")})


_FEAT = " ".join(f"{m}:f" for m in M)
_RK = " ".join(f"rank_{m}:i" for m in M)


@register("N6_feature_table", f"wwtp:s {_FEAT}", "SELECT * FROM fx_features")
def _n6(spark, sf):
    return features(spark, sf)


@register("N6_feature_table_month", f"year_month:s wwtp:s {_FEAT}", "SELECT * FROM fx_features_month")
def _n6m(spark, sf):
    return month_features(spark, sf)


@register("N7_clean_graph", "u:s v:s", "SELECT * FROM fx_half_edges")
def _n7(spark, sf):
    s = half_sites(spark, sf)
    return graph.clean_graph(s, graph.site_edges(s))[1]


@register("K1_rank_columns", f"wwtp:s {_RK}", "SELECT * FROM fx_ranks")
def _k1(spark, sf):
    return ranking.rank_columns(features(spark, sf), M)


@register("K2_month_rank_table", f"year_month:s wwtp:s {_RK} final_rank:f", "SELECT * FROM fx_ranks_month")
def _k2(spark, sf):
    return ranking.month_rank_table(month_features(spark, sf), parts=["year_month"])


TABLES["fx_risk_rank"] = """SELECT *, CASE WHEN combined_risk IS NOT NULL THEN rank() OVER (PARTITION BY year_month ORDER BY ROUND(combined_risk, 6) DESC NULLS LAST) END AS rank_combined_risk FROM fx_risk_month"""


@register(
    "K2_month_rank_table_risk", f"year_month:s wwtp:s {_RK} rank_combined_risk:f final_rank:f",
    f"""SELECT COALESCE(r.year_month, k.year_month) AS year_month, COALESCE(r.wwtp, k.wwtp) AS wwtp, {', '.join('rank_' + m for m in M)},
        rank_combined_risk, list_median(list_filter([{', '.join(f'CAST(rank_{m} AS DOUBLE)' for m in M)}, CAST(rank_combined_risk AS DOUBLE)], lambda v: v IS NOT NULL)) AS final_rank
        FROM fx_ranks_month r FULL JOIN fx_risk_rank k ON r.year_month = k.year_month AND r.wwtp = k.wwtp""",
)
def _k2r(spark, sf):
    edges = stage_table(dt.weekly_edges(spark, sf))
    risk = stage_table(monthly_risk_signal(summary(spark, sf, edges)))
    return ranking.month_rank_table(month_features(spark, sf, edges), risk, "median", ["year_month"])


@register(
    "K3_rank_lists", "position:i full_list:s top10:s top20:s top30:s top40:s top50:s",
    "SELECT ord AS position, wwtp AS full_list, "
    + ", ".join(f"CASE WHEN ord <= {k} THEN wwtp END AS top{k}" for k in (10, 20, 30, 40, 50)) + " FROM fx_order",
)
def _k3(spark, sf):
    return ranking.rank_lists(ranking.month_rank_table(features(spark, sf)), [10, 20, 30, 40, 50])


@register(
    "K4_ej_rank", "wwtp:s score:f rank_score:i",
    "SELECT f.wwtp, score, CASE WHEN score IS NOT NULL THEN rank() OVER (ORDER BY score DESC NULLS LAST) END AS rank_score FROM fx_features f LEFT JOIN fx_scores s ON f.wwtp = s.wwtp",
)
def _k4(spark, sf):
    return ranking.ej_rank(features(spark, sf), dt.scores(spark, sf).withColumn("ord", F.lit(1)))


@register(
    "K5_common_top_sites", "wwtp:s months_in_top:i",
    """SELECT wwtp, COUNT(*) AS months_in_top FROM (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY final_rank, wwtp) AS rn
       FROM fx_ranks_month WHERE year_month IN (SELECT DISTINCT year_month FROM fx_ranks_month ORDER BY 1 DESC LIMIT 12)) WHERE rn <= 20 GROUP BY 1""",
)
def _k5(spark, sf):
    ranks = ranking.month_rank_table(month_features(spark, sf), parts=["year_month"])
    return ranking.common_top_sites(ranks, 20, 12)


def _mm(c: str) -> str:
    return f"COALESCE(({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 0)"


TABLES["fx_importance"] = f"""
SELECT r.*, nearest_km, (1 - {_mm('final_rank')}) + 0.5 * (0.5 * {_mm('pop_served')} + 0.5 * {_mm('pop_covered_by_od')})
  + 0.5 * CASE WHEN nearest_km >= 100 THEN 1 ELSE 0 END AS importance FROM fx_ranks r JOIN fx_nearest n ON r.wwtp = n.wwtp"""


@register("K6_singleton_importance", "wwtp:s importance:r nearest_km:f", "SELECT * FROM fx_importance")
def _k6(spark, sf):
    f = features(spark, sf)
    d = f.join(ranking.rank_columns(f, M), "wwtp").join(graph.nearest_other(dt.sites(spark, sf)), "wwtp")
    return ranking.singleton_importance(d)


@register(
    "K7_thresholds", f"wwtp:s {_RK} top_any:b bottom_all:b",
    "SELECT *, " + " OR ".join(f"rank_{m} <= ceil(0.3 * n)" for m in M) + " AS top_any, "
    + " AND ".join(f"rank_{m} >= floor(0.8 * n)" for m in M) + " AS bottom_all FROM (SELECT *, COUNT(*) OVER () AS n FROM fx_ranks)",
)
def _k7(spark, sf):
    return ranking.thresholds(ranking.rank_columns(features(spark, sf), M))


@register(
    "K8_cross_ranks", "wwtp:s own_order:i rank_mobility:i rank_level1:i shade:r",
    """SELECT p.wwtp, p.ord AS own_order, m.ord AS rank_mobility, l.ord AS rank_level1, 1 - (l.ord - 1) / CAST((SELECT COUNT(*) - 1 FROM fx_features) AS DOUBLE) AS shade
       FROM fx_orders p JOIN fx_orders m ON p.wwtp = m.wwtp AND m.strategy = 'mobility' JOIN fx_orders l ON p.wwtp = l.wwtp AND l.strategy = 'level1'
       WHERE p.strategy = 'population'""",
)
def _k8(spark, sf):
    f = features(spark, sf)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    c = ranking.cross_ranks(orders(f), "population", ["mobility", "level1"])
    return c.crossJoin(F.broadcast(n)).withColumn("shade", ranking.rank_shade(F.col("rank_level1"), F.col("n")))


@register("K9_avg_rank_from_month", "wwtp:s avg_rank:f", "SELECT wwtp, final_rank AS avg_rank FROM fx_ranks_month")
def _k9(spark, sf):
    return ranking.avg_rank_from_month(ranking.month_rank_table(month_features(spark, sf), parts=["year_month"]))


@register(
    "V1_cumulative", "strategy:s ord:i wwtp:s " + " ".join(f"delta_{m}:f cum_{m}:f frac_{m}:r" for m in M),
    "SELECT o.strategy, o.ord, o.wwtp, " + ", ".join(
        f"{m} AS delta_{m}, SUM({m}) OVER (PARTITION BY o.strategy ORDER BY o.ord) AS cum_{m}, "
        f"SUM({m}) OVER (PARTITION BY o.strategy ORDER BY o.ord) / NULLIF(SUM({m}) OVER (PARTITION BY o.strategy), 0) AS frac_{m}" for m in M)
    + " FROM fx_orders o JOIN fx_features f ON o.wwtp = f.wwtp",
)
def _v1(spark, sf):
    f = features(spark, sf)
    return cov.cumulative(f, orders(f))


TABLES["fx_link_sum"] = """
SELECT bg_fips, wwtp, SUM(volume) AS s, MAX(MAX(population)) OVER (PARTITION BY bg_fips) AS population, MAX(MAX(area)) OVER (PARTITION BY bg_fips) AS area,
  SUM(SUM(volume)) OVER (PARTITION BY bg_fips) AS site_sum FROM fx_links WHERE direction = 'Destination' GROUP BY 1, 2"""
_W = {
    "share": "s / site_sum", "intensity_cap": "least(1.0, s / (2.0 * (population + 100.0)))",
    "intensity_exp": "1 - exp(-s / (2.0 * (population + 100.0)))",
}
for _m, _e in _W.items():
    TABLES[f"fx_weights_{_m}"] = f"SELECT bg_fips, wwtp, {_e} AS w, population, area FROM fx_link_sum"

    def _v2(spark, sf, mode=_m):
        return cov.link_weights(dt.bg_links(spark, sf), mode=mode)

    register(f"V2_link_weights_{_m}", "bg_fips:s wwtp:s w:h population:f area:f", f"SELECT * FROM fx_weights_{_m}")(_v2)


def _steps_sql(gain: str, orders_table: str = "fx_orders", weights: str = "fx_weights_intensity_exp") -> str:
    return f"""SELECT strategy, ord, wwtp, bg_fips, population, area, w, {gain} AS gain FROM (
      SELECT o.strategy, o.ord, w.*, SUM(w.w) OVER win AS s, row_number() OVER win AS rn,
        exp(SUM(CASE WHEN w.w < 1 THEN ln(1 - w.w) ELSE 0 END) OVER win) AS q, CASE WHEN w.w < 1 THEN 1 - w.w ELSE 1 END AS q1
      FROM {weights} w JOIN {orders_table} o ON w.wwtp = o.wwtp
      WINDOW win AS (PARTITION BY o.strategy, w.bg_fips ORDER BY o.ord))"""


TABLES["fx_steps"] = _steps_sql("least(1.0, s) - least(1.0, s - w)")


def _curve_sql(steps: str, orders_table: str = "fx_orders") -> str:
    return f"""SELECT o.strategy, o.ord, o.wwtp, COALESCE(dp, 0) AS delta_population, COALESCE(da, 0) AS delta_area,
      SUM(COALESCE(dp, 0)) OVER (PARTITION BY o.strategy ORDER BY o.ord) AS cum_population,
      SUM(COALESCE(da, 0)) OVER (PARTITION BY o.strategy ORDER BY o.ord) AS cum_area
      FROM {orders_table} o LEFT JOIN (SELECT strategy, ord, SUM(population * gain) AS dp, SUM(area * gain) AS da FROM ({steps}) GROUP BY 1, 2) d
      ON o.strategy = d.strategy AND o.ord = d.ord"""


_GAIN = {"cap_sum": "least(1.0, s) - least(1.0, s - w)", "prob_union": "(1 - q) - (1 - q / q1)", "binary": "CASE WHEN rn = 1 THEN 1.0 ELSE 0.0 END"}
for _u, _g in _GAIN.items():

    def _v3(spark, sf, union=_u):
        f = features(spark, sf)
        w = stage(cov.link_weights(dt.bg_links(spark, sf), union_mode=union))
        return cov.union_coverage(orders(f), w, union)

    register(
        f"V3_union_coverage_{_u}", "strategy:s ord:i wwtp:s delta_population:f delta_area:f cum_population:f cum_area:f",
        _curve_sql(_steps_sql(_g)),
    )(_v3)

def full_curve_sql(orders_table: str, steps_table: str) -> str:
    """Coverage curves of every strategy of a table of orders."""
    return f"""
SELECT c.*, cum_population / lp AS frac_population, cum_area / la AS frac_area, cum_pop_served, cum_pop_served / served AS frac_pop_served,
  cum_od_volume_total, cum_od_volume_total / vol AS frac_volume, lp AS linked_population, la AS linked_area FROM ({_curve_sql(f'SELECT * FROM {steps_table}', orders_table)}) c
JOIN (SELECT o.strategy, o.ord, SUM(pop_served) OVER w AS cum_pop_served, SUM(od_volume_total) OVER w AS cum_od_volume_total,
   SUM(pop_served) OVER (PARTITION BY o.strategy) AS served FROM {orders_table} o JOIN fx_features f ON o.wwtp = f.wwtp WINDOW w AS (PARTITION BY o.strategy ORDER BY o.ord)) a
 ON c.strategy = a.strategy AND c.ord = a.ord
CROSS JOIN (SELECT SUM(od_volume_total) AS vol FROM fx_features)
CROSS JOIN (SELECT SUM(population) AS lp, SUM(area) AS la FROM (SELECT DISTINCT bg_fips, population, area FROM fx_weights_share))"""


TABLES["fx_curve"] = full_curve_sql("fx_orders", "fx_steps")
_CURVE = ("strategy:s ord:i wwtp:s delta_population:f cum_population:f delta_area:f cum_area:f frac_population:r frac_area:r "
          "cum_pop_served:f frac_pop_served:r cum_od_volume_total:f frac_volume:r linked_population:f linked_area:f")


@register("V4_coverage_table", _CURVE, "SELECT * FROM fx_curve WHERE strategy = 'level1'")
def _v4(spark, sf):
    f = features(spark, sf)
    return cov.coverage_table(stage(level1_order(f)), dt.bg_links(spark, sf), f)


@register("V5_coverage_at_k", _CURVE, "SELECT * FROM fx_curve WHERE ord IN (20, 40, 60)")
def _v5(spark, sf):
    f = features(spark, sf)
    return cov.coverage_at_k(cov.coverage_table(orders(f), dt.bg_links(spark, sf), f), [20, 40, 60])


@register(
    "V6_selected_summary", "n_input:i n_unique:i n_matched:i n_missing:i " + " ".join(f"sel_{m}:f frac_{m}:r" for m in M),
    "SELECT COUNT(*) AS n_input, COUNT(*) AS n_unique, COUNT(*) AS n_matched, 0 AS n_missing, "
    + ", ".join(f"SUM({m}) AS sel_{m}, SUM({m}) / (SELECT SUM({m}) FROM fx_features) AS frac_{m}" for m in M)
    + " FROM fx_features WHERE wwtp IN (SELECT wwtp FROM fx_sites WHERE act_sts LIKE 'sentinel%')",
)
def _v6(spark, sf):
    sel = dt.sites(spark, sf).filter(F.col("act_sts").startswith("sentinel"))
    return cov.selected_summary(sel, features(spark, sf))


@register("V7_coverage_for_orders", _CURVE, "SELECT * FROM fx_curve")
def _v7(spark, sf):
    f = features(spark, sf)
    return cov.coverage_for_orders(orders(f), dt.bg_links(spark, sf), f)
