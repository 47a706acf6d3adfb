"""Queries for strategy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netreach.operators import areal, evaluation as ev
from netreach.operators.coverage import coverage_for_orders, link_weights
from netreach.plans.staging import stage
from netreach.registry.base import register
from netreach.registry.q_graph import _CURVE, _GAIN, _steps_sql, features, full_curve_sql, level1_order
from netreach.registry.q_select import shared_tables, strategies
from netreach.registry.sqltables import TABLES
from netreach.sources import driver_tables as dt

def counties(spark, sf):
    """Linked counties of a site: those it exchanges trips with, over the whole table."""
    return dt.weekly_edges(spark, sf).select("wwtp", "county_fips").distinct()


def cbsa(spark, sf):
    return stage(areal.assign_cbsa(dt.sites(spark, sf), dt.cbsa_polygons(spark, sf), 100.0))


def metro(spark, sf):
    return areal.metro_counties(dt.county_polygons(spark, sf), dt.cbsa_polygons(spark, sf), 100.0)


def weights(spark, sf):
    return stage(link_weights(dt.bg_links(spark, sf)))


@register(
    "E1_overlap", "strategy:s n_sites:i n_primary:i n_overlap:i frac_of_strategy:r frac_of_primary:r jaccard:r overlap_sites:s only_sites:s",
    """SELECT *, n_overlap / CAST(n_sites AS DOUBLE) AS frac_of_strategy, n_overlap / CAST(n_primary AS DOUBLE) AS frac_of_primary,
       n_overlap / CAST(n_sites + n_primary - n_overlap AS DOUBLE) AS jaccard FROM (
       SELECT o.strategy, COUNT(*) AS n_sites, (SELECT COUNT(*) FROM fx_top WHERE strategy = 'level1') AS n_primary, COUNT(p.wwtp) AS n_overlap,
        COALESCE(string_agg(CASE WHEN p.wwtp IS NOT NULL THEN o.wwtp END, ';' ORDER BY o.wwtp), '') AS overlap_sites,
        COALESCE(string_agg(CASE WHEN p.wwtp IS NULL THEN o.wwtp END, ';' ORDER BY o.wwtp), '') AS only_sites
       FROM fx_top o LEFT JOIN fx_top p ON o.wwtp = p.wwtp AND p.strategy = 'level1' GROUP BY 1)""",
)
def _e1(spark, sf):
    return ev.overlap(strategies(spark, sf, shared_tables(spark, sf)), "level1")


@register(
    "E1_membership", "wwtp:s in_population:b in_polygon:b in_cbsa:b in_level1:b n_strategies:i",
    """SELECT wwtp, bool_or(strategy = 'population') AS in_population, bool_or(strategy = 'polygon') AS in_polygon,
       bool_or(strategy = 'cbsa') AS in_cbsa, bool_or(strategy = 'level1') AS in_level1, COUNT(*) AS n_strategies FROM fx_top GROUP BY 1""",
)
def _e1m(spark, sf):
    return ev.membership(strategies(spark, sf, shared_tables(spark, sf)), ["population", "polygon", "cbsa", "level1"])


TABLES["fx_spatial"] = """
SELECT o.strategy, COUNT(*) AS n_sites, COUNT(DISTINCT component) AS n_components, (SELECT COUNT(DISTINCT component) FROM fx_components) AS n_components_all,
 COUNT(*) FILTER (component_size = 1) AS n_singleton_sites, COUNT(*) FILTER (component_size <= 2) AS n_small_component_sites,
 COUNT(*) FILTER (component_size > 2) AS n_large_component_sites, MIN(nc) AS n_counties, MIN(nn) AS mean_nn_km,
 COUNT(DISTINCT cbsa) AS n_cbsa, COUNT(DISTINCT CASE WHEN cbsa_type = 'Metro' THEN cbsa END) AS n_metro_cbsa,
 COUNT(DISTINCT CASE WHEN cbsa_type = 'Micro' THEN cbsa END) AS n_micro_cbsa, COUNT(*) FILTER (NOT in_cbsa) AS n_outside_cbsa_sites,
 AVG(CASE WHEN in_cbsa THEN 1.0 ELSE 0.0 END) AS cbsa_site_frac, AVG(CASE WHEN cbsa_type = 'Metro' THEN 1.0 ELSE 0.0 END) AS metro_site_frac,
 COUNT(DISTINCT component) / CAST((SELECT COUNT(DISTINCT component) FROM fx_components) AS DOUBLE) AS component_representation_frac
FROM fx_top o JOIN fx_components c ON o.wwtp = c.wwtp JOIN fx_site_cbsa b ON o.wwtp = b.wwtp
JOIN (SELECT strategy, COUNT(DISTINCT county_fips) AS nc FROM fx_top t JOIN fx_edges e ON t.wwtp = e.wwtp GROUP BY 1) k ON o.strategy = k.strategy
JOIN (SELECT strategy, AVG(d) AS nn FROM (SELECT a.strategy, a.wwtp, MIN(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d
  FROM fx_top a JOIN fx_top b ON a.strategy = b.strategy AND a.wwtp <> b.wwtp JOIN fx_sites p ON a.wwtp = p.wwtp JOIN fx_sites q ON b.wwtp = q.wwtp GROUP BY 1, 2) GROUP BY 1) m
  ON o.strategy = m.strategy GROUP BY 1"""
_SPATIAL = ("strategy:s n_sites:i n_components:i n_components_all:i n_singleton_sites:i n_small_component_sites:i n_large_component_sites:i n_counties:i "
            "mean_nn_km:f n_cbsa:i n_metro_cbsa:i n_micro_cbsa:i n_outside_cbsa_sites:i cbsa_site_frac:r metro_site_frac:r component_representation_frac:r")


@register("E2_spatial_stats", _SPATIAL, "SELECT * FROM fx_spatial")
def _e2(spark, sf):
    shared = shared_tables(spark, sf)
    o = strategies(spark, sf, shared)
    return ev.spatial_stats(o, dt.sites(spark, sf), shared[2], counties(spark, sf), cbsa(spark, sf))


TABLES["fx_score_base"] = """
SELECT f.wwtp, pop_served AS pop, score, COALESCE(score >= (SELECT quantile_cont(score, 0.75) FROM fx_features g JOIN fx_scores h ON g.wwtp = h.wwtp), FALSE) AS high
FROM fx_features f LEFT JOIN fx_scores s ON f.wwtp = s.wwtp"""
TABLES["fx_score_stats"] = """
SELECT strategy, AVG(score) AS score_mean, quantile_cont(score, 0.5) AS score_median,
 SUM(COALESCE(score, 0) * pop) / NULLIF(SUM(CASE WHEN score IS NOT NULL THEN pop END), 0) AS score_pop_weighted_mean,
 SUM(COALESCE(score, 0) * pop) / (SELECT SUM(COALESCE(score, 0) * pop) FROM fx_score_base) AS score_pop_frac,
 COUNT(*) FILTER (high) AS n_high_sites, COUNT(*) FILTER (high) / CAST((SELECT COUNT(*) FILTER (high) FROM fx_score_base) AS DOUBLE) AS high_sites_frac,
 COALESCE(SUM(CASE WHEN high THEN pop END), 0) / (SELECT SUM(pop) FROM fx_score_base WHERE high) AS high_pop_frac
FROM fx_top o JOIN fx_score_base b ON o.wwtp = b.wwtp GROUP BY 1"""
_SCORE = "strategy:s score_mean:f score_median:f score_pop_weighted_mean:f score_pop_frac:r n_high_sites:i high_sites_frac:r high_pop_frac:r"


@register("E3_score_stats", _SCORE, "SELECT * FROM fx_score_stats")
def _e3(spark, sf):
    shared = shared_tables(spark, sf)
    f = shared[1]
    return ev.score_stats(strategies(spark, sf, shared), dt.scores(spark, sf), f)


TABLES["fx_top_steps"] = _steps_sql(_GAIN["cap_sum"], "fx_top")
TABLES["fx_bg_mass"] = "SELECT DISTINCT bg_fips, substr(bg_fips, 1, 5) AS county_fips, area, population FROM fx_weights_share"
TABLES["fx_county_frac"] = """
SELECT s.strategy, c.county_fips, least(1.0, greatest(0.0, COALESCE(got, 0) / total)) AS frac FROM (SELECT DISTINCT strategy FROM fx_top) s
CROSS JOIN (SELECT county_fips, SUM(area) AS total FROM fx_bg_mass GROUP BY 1) c
LEFT JOIN (SELECT strategy, substr(bg_fips, 1, 5) AS county_fips, SUM(area * gain) AS got FROM fx_top_steps GROUP BY 1, 2) g
 ON g.strategy = s.strategy AND g.county_fips = c.county_fips"""
TABLES["fx_site_gain"] = "SELECT strategy, wwtp, SUM(area * gain) AS a, SUM(population * gain) AS p FROM fx_top_steps GROUP BY 1, 2"
TABLES["fx_contribution"] = """
SELECT c.*, ea / n AS site_area_evenness, ep / n AS site_pop_evenness, t1 / s AS top1_frac, t3 / s AS top3_frac FROM (
 SELECT strategy, COUNT(*) AS n_counties_total, COUNT(*) FILTER (frac > 0) AS n_counties_reached, COUNT(*) FILTER (frac > 0) / CAST(COUNT(*) AS DOUBLE) AS counties_reached_frac,
  COUNT(*) FILTER (ROUND(frac, 9) >= 0.05) AS n_counties_contributing, COUNT(*) FILTER (ROUND(frac, 9) >= 0.05) / CAST(COUNT(*) AS DOUBLE) AS counties_contributing_frac,
  AVG(frac) AS county_coverage_mean, quantile_cont(frac, 0.5) AS county_coverage_median, MIN(frac) AS county_coverage_min FROM fx_county_frac GROUP BY 1) c
JOIN (SELECT strategy, COUNT(*) AS n FROM fx_top GROUP BY 1) k ON c.strategy = k.strategy
JOIN (SELECT strategy, SUM(a) AS s, SUM(a) * SUM(a) / SUM(a * a) AS ea, SUM(p) * SUM(p) / SUM(p * p) AS ep, MAX(a) AS t1, SUM(a) FILTER (rn <= 3) AS t3
 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY a DESC, wwtp) AS rn FROM fx_site_gain) GROUP BY 1) e ON c.strategy = e.strategy"""
_CONTR = ("strategy:s n_counties_total:i n_counties_reached:i counties_reached_frac:r n_counties_contributing:i counties_contributing_frac:r county_coverage_mean:r "
          "county_coverage_median:r county_coverage_min:r site_area_evenness:r site_pop_evenness:r top1_frac:r top3_frac:r")


@register("E4_county_contribution", _CONTR, "SELECT * FROM fx_contribution")
def _e4(spark, sf):
    return ev.county_contribution(strategies(spark, sf, shared_tables(spark, sf)), weights(spark, sf))


@register(
    "E5_county_balanced", "strategy:s county:s contribution:r",
    """SELECT strategy, COALESCE(b.county_fips, 'Other counties') AS county, SUM(frac / (SELECT COUNT(DISTINCT county_fips) FROM fx_bg_mass)) AS contribution
       FROM fx_county_frac f LEFT JOIN (SELECT county_fips FROM fx_county_frac GROUP BY 1 ORDER BY ROUND(SUM(frac / (SELECT COUNT(DISTINCT county_fips) FROM fx_bg_mass)), 9) DESC, county_fips LIMIT 8) b
       ON f.county_fips = b.county_fips GROUP BY 1, 2""",
)
def _e5(spark, sf):
    return ev.county_balanced(strategies(spark, sf, shared_tables(spark, sf)), weights(spark, sf))


TABLES["fx_nonmetro"] = """
SELECT strategy, SUM(area * c) / MIN(ta) AS nonmetro_area_frac, SUM(population * c) / MIN(pt) AS nonmetro_pop_frac,
 COUNT(*) FILTER (c > 0) / CAST(MIN(n) AS DOUBLE) AS nonmetro_bg_frac, MIN(n) AS n_nonmetro_total, COUNT(*) FILTER (c > 0) AS n_nonmetro_reached FROM
 (SELECT strategy, bg_fips, least(1.0, SUM(gain)) AS c FROM fx_top_steps GROUP BY 1, 2) s
 JOIN (SELECT * FROM fx_bg_mass WHERE county_fips NOT IN (SELECT county_fips FROM fx_metro)) m ON s.bg_fips = m.bg_fips
 CROSS JOIN (SELECT SUM(area) AS ta, SUM(population) AS pt, COUNT(*) AS n FROM fx_bg_mass WHERE county_fips NOT IN (SELECT county_fips FROM fx_metro)) GROUP BY 1"""
_NON = "strategy:s nonmetro_area_frac:r nonmetro_pop_frac:r nonmetro_bg_frac:r n_nonmetro_total:i n_nonmetro_reached:i"


@register("E6_nonmetro_reach", _NON, "SELECT * FROM fx_nonmetro")
def _e6(spark, sf):
    return ev.nonmetro_reach(strategies(spark, sf, shared_tables(spark, sf)), weights(spark, sf), metro(spark, sf))


TABLES["fx_site_risk"] = "SELECT f.wwtp, greatest(COALESCE(score, 0), 0) AS risk FROM fx_features f LEFT JOIN fx_scores s ON f.wwtp = s.wwtp"
TABLES["fx_capture"] = """
SELECT strategy, SUM(risk) AS risk_cum, SUM(risk) / (SELECT SUM(risk) FROM fx_site_risk) AS risk_frac,
 COUNT(*) FILTER (risk >= q) AS n_high_risk, COUNT(*) FILTER (risk >= q) / CAST((SELECT COUNT(*) FROM fx_site_risk WHERE risk >= (SELECT quantile_cont(risk, 0.75) FROM fx_site_risk)) AS DOUBLE) AS high_risk_frac
FROM fx_top o JOIN fx_site_risk r ON o.wwtp = r.wwtp CROSS JOIN (SELECT quantile_cont(risk, 0.75) AS q FROM fx_site_risk) GROUP BY 1"""


def site_risk(spark, sf):
    return dt.scores(spark, sf).withColumnRenamed("score", "risk")


@register("E7_risk_capture", "strategy:s risk_cum:f risk_frac:r n_high_risk:i high_risk_frac:r", "SELECT * FROM fx_capture")
def _e7(spark, sf):
    shared = shared_tables(spark, sf)
    f = shared[1]
    return ev.risk_capture(strategies(spark, sf, shared), site_risk(spark, sf), f)


TABLES["fx_top_curves"] = full_curve_sql("fx_top", "fx_top_steps")
TABLES["fx_top_curve"] = "SELECT * FROM fx_top_curves QUALIFY ord = MAX(ord) OVER (PARTITION BY strategy)"


@register("V7_coverage_for_strategies", _CURVE, "SELECT * FROM fx_top_curves")
def _v7s(spark, sf):
    shared = shared_tables(spark, sf)
    f = shared[1]
    return coverage_for_orders(strategies(spark, sf, shared), dt.bg_links(spark, sf), f)


_DES = "[frac_area, frac_volume, counties_contributing_frac, site_area_evenness, component_representation_frac]"
_COR = "[frac_pop_served, frac_population, frac_area, frac_volume]"
TABLES["fx_evaluation"] = f"""
SELECT *, list_avg({_COR}) AS balance_core_mean, list_min({_COR}) AS balance_core_min, list_avg({_DES}) AS design_mean, list_min({_DES}) AS design_min,
 5 AS design_metric_count, list_min({_DES}) AS minimum_benefit_score
FROM fx_top_curve JOIN fx_contribution USING (strategy) JOIN fx_nonmetro USING (strategy) JOIN fx_spatial USING (strategy)
JOIN fx_score_stats USING (strategy) JOIN fx_capture USING (strategy)"""
_BAL = "balance_core_mean:r balance_core_min:r design_mean:r design_min:r design_metric_count:i minimum_benefit_score:r"
_EVAL = ("strategy:s cum_population:f cum_area:f cum_pop_served:f cum_od_volume_total:f frac_pop_served:r frac_population:r frac_area:r frac_volume:r "
         + " ".join(s.replace("strategy:s ", "") for s in (_CONTR, _NON, _SPATIAL, _SCORE)) + " risk_cum:f risk_frac:r n_high_risk:i high_risk_frac:r " + _BAL)


def evaluation(spark, sf):
    shared = shared_tables(spark, sf)
    _, f, comps = shared
    return ev.evaluate(
        strategies(spark, sf, shared), dt.bg_links(spark, sf), f, dt.sites(spark, sf), comps, counties(spark, sf), cbsa(spark, sf),
        metro(spark, sf), dt.scores(spark, sf), site_risk(spark, sf))


@register("E8_balance_scores", "strategy:s " + _BAL, "SELECT * FROM fx_evaluation")
def _e8(spark, sf):
    return evaluation(spark, sf)


@register("E9_evaluate", _EVAL, "SELECT * FROM fx_evaluation")
def _e9(spark, sf):
    return evaluation(spark, sf)


@register(
    "E9_evaluate_without_links", "strategy:s frac_pop_served:r frac_population:r frac_area:r frac_volume:r",
    """SELECT o.strategy, 1.0 AS frac_pop_served, 1.0 AS frac_population, 1.0 AS frac_area, 1.0 AS frac_volume FROM fx_top o GROUP BY 1""",
)
def _e9n(spark, sf):
    shared = shared_tables(spark, sf)
    _, f, comps = shared
    return ev.evaluate(
        strategies(spark, sf, shared), None, f, dt.sites(spark, sf), comps, counties(spark, sf), cbsa(spark, sf), metro(spark, sf),
        dt.scores(spark, sf), site_risk(spark, sf))


TABLES["fx_path_scores"] = """
SELECT CASE l_returnflag WHEN 'R' THEN 'covid' WHEN 'A' THEN 'flu' ELSE 'rsv' END AS pathogen, CAST(l_suppkey AS VARCHAR) AS wwtp, ROUND(SUM(l_extendedprice), 2) AS score FROM lineitem GROUP BY 1, 2"""
TABLES["fx_score_rank"] = """
SELECT *, CASE WHEN a AND b THEN 'Both' WHEN a THEN 'L1 only' WHEN b THEN 'Pop only' ELSE 'Neither' END AS grp FROM (
SELECT s.pathogen, s.wwtp, s.score, rank() OVER (PARTITION BY s.pathogen ORDER BY s.score DESC) AS score_rank, p.pop, p.pop_rank, p.pop_percentile, o.ord AS level1_rank,
 rank() OVER (PARTITION BY s.pathogen ORDER BY s.score DESC) <= 20 AS t, o.ord <= 20 AS a, p.pop_rank <= 20 AS b FROM fx_path_scores s
JOIN (SELECT wwtp, pop_served AS pop, rank() OVER (ORDER BY pop_served DESC) AS pop_rank,
  (rank() OVER (ORDER BY pop_served) + (COUNT(*) OVER (PARTITION BY pop_served) - 1) / 2.0) / COUNT(*) OVER () * 100 AS pop_percentile FROM fx_features) p ON s.wwtp = p.wwtp
JOIN fx_order o ON s.wwtp = o.wwtp)"""


def path_scores(spark, sf):
    flag = F.col("l_returnflag")
    return dt.table(spark, sf, "lineitem").groupBy(
        F.when(flag == "R", "covid").when(flag == "A", "flu").otherwise("rsv").alias("pathogen"), F.col("l_suppkey").cast("string").alias("wwtp")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))


def score_rank(spark, sf):
    f = features(spark, sf)
    return ev.score_vs_rank(path_scores(spark, sf), stage(level1_order(f)), f)


@register(
    "E10_score_vs_rank", "pathogen:s wwtp:s score:f score_rank:i pop_rank:i pop_percentile:f level1_rank:i grp:s missed_by_level1:b missed_by_pop:b captured_by_both:b",
    "SELECT *, t AND NOT a AS missed_by_level1, t AND NOT b AS missed_by_pop, t AND a AND b AS captured_by_both FROM fx_score_rank",
)
def _e10(spark, sf):
    return score_rank(spark, sf).withColumnRenamed("group", "grp")


@register(
    "F14_membership_group", "grp:s n:i missed_by_level1:i missed_by_pop:i captured_by_both:i captured_by_level1_only:i captured_by_pop_only:i",
    """SELECT grp, COUNT(*) AS n, COUNT(*) FILTER (t AND NOT a) AS missed_by_level1, COUNT(*) FILTER (t AND NOT b) AS missed_by_pop, COUNT(*) FILTER (t AND a AND b) AS captured_by_both,
       COUNT(*) FILTER (t AND a AND NOT b) AS captured_by_level1_only, COUNT(*) FILTER (t AND b AND NOT a) AS captured_by_pop_only FROM fx_score_rank GROUP BY 1""",
)
def _f14(spark, sf):
    flags = ["missed_by_level1", "missed_by_pop", "captured_by_both", "captured_by_level1_only", "captured_by_pop_only"]
    return score_rank(spark, sf).groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in flags])


@register(
    "E10_score_vs_rank_summary", "pathogen:s overlap_level1:i overlap_pop:i missed_level1:i missed_pop:i spearman_level1:r spearman_pop:r",
    """SELECT pathogen, COUNT(*) FILTER (t AND a) AS overlap_level1, COUNT(*) FILTER (t AND b) AS overlap_pop, COUNT(*) FILTER (t AND NOT a) AS missed_level1,
       COUNT(*) FILTER (t AND NOT b) AS missed_pop, corr(rs, rl) AS spearman_level1, corr(rs, rp) AS spearman_pop FROM (SELECT *,
       rank() OVER (PARTITION BY pathogen ORDER BY score) + (COUNT(*) OVER (PARTITION BY pathogen, score) - 1) / 2.0 AS rs,
       rank() OVER (PARTITION BY pathogen ORDER BY level1_rank DESC) AS rl,
       rank() OVER (PARTITION BY pathogen ORDER BY pop) + (COUNT(*) OVER (PARTITION BY pathogen, pop) - 1) / 2.0 AS rp FROM fx_score_rank) GROUP BY 1""",
)
def _e10s(spark, sf):
    return ev.score_vs_rank_summary(score_rank(spark, sf))


@register(
    "E11_normalize_for_display", "strategy:s risk_frac_norm:r risk_cum_norm:r n_high_risk_norm:r",
    """SELECT strategy, least(greatest(risk_frac, 0), 1) AS risk_frac_norm, COALESCE((risk_cum - MIN(risk_cum) OVER ()) / NULLIF(MAX(risk_cum) OVER () - MIN(risk_cum) OVER (), 0), 0) AS risk_cum_norm,
       COALESCE((n_high_risk - MIN(n_high_risk) OVER ()) / NULLIF(CAST(MAX(n_high_risk) OVER () - MIN(n_high_risk) OVER () AS DOUBLE), 0), 0) AS n_high_risk_norm FROM fx_capture""",
)
def _e11(spark, sf):
    shared = shared_tables(spark, sf)
    f = shared[1]
    return ev.normalize_for_display(stage(ev.risk_capture(strategies(spark, sf, shared), site_risk(spark, sf), f)), ["risk_frac"], ["risk_cum", "n_high_risk"])
