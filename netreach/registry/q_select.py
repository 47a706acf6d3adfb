"""Queries for selection, baselines and areal allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netreach.operators import areal, baselines, graph, ranking, selection
from netreach.operators.risk import monthly_risk_signal
from netreach.plans.staging import stage, stage_table
from netreach.registry.base import register
from netreach.registry.q_graph import features, half_sites, month_coverage
from netreach.registry.q_od import _YM
from netreach.registry.q_risk import summary
from netreach.registry.sqltables import TABLES
from netreach.sources import driver_tables as dt

M = graph.METRICS
N = 20
CELL = 2.0

# ---------------------------------------------------------------- areal allocation


def _cells_sql(key: str, source: str, where: str = "") -> str:
    return f"""SELECT {key}, cx, cy FROM (SELECT {key}, cx, y, h, unnest(generate_series(CAST(floor((y - h) / 2) AS BIGINT), CAST(floor((y + h) / 2) AS BIGINT))) AS cy FROM
      (SELECT {key}, x, y, h, unnest(generate_series(CAST(floor((x - h) / 2) AS BIGINT), CAST(floor((x + h) / 2) AS BIGINT))) AS cx FROM ({source}))
      WHERE (cx + 0.5) * 2 >= x - h AND (cx + 0.5) * 2 < x + h) WHERE (cy + 0.5) * 2 >= y - h AND (cy + 0.5) * 2 < y + h"""


TABLES["fx_areas"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS area_id,
 lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips, greatest(c_acctbal, 0.0) AS population,
 CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1000 AS DOUBLE) AS y, CAST(3.25 + c_custkey % 5 AS DOUBLE) AS h,
 CAST(4 * (3.25 + c_custkey % 5) * (3.25 + c_custkey % 5) AS DOUBLE) AS area FROM customer"""
TABLES["fx_county_tiles"] = """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips, n_name || ' County' AS county_name, n_nationkey AS k,
 CAST((n_nationkey % 5) * 200 + 99.5 AS DOUBLE) AS x, CAST((n_nationkey // 5) * 200 + 99.5 AS DOUBLE) AS y, CAST(100.0 AS DOUBLE) AS h,
 CAST((n_nationkey % 5) * 200 + 99.5 + (n_nationkey * 7) % 90 AS DOUBLE) AS px FROM nation"""
TABLES["fx_cbsa"] = """
SELECT 'cb' || county_fips AS cbsa, 'area ' || replace(county_name, ' County', '') AS name, 'M' || CAST(k % 3 + 1 AS VARCHAR) AS lsad, x, y, CAST(25.0 + 3 * k AS DOUBLE) AS h
FROM fx_county_tiles"""
TABLES["fx_site_cells"] = _cells_sql("wwtp", "SELECT wwtp, x, y, radius / 2 + 0.25 AS h FROM fx_sites")
TABLES["fx_area_cells"] = _cells_sql("area_id", "SELECT * FROM fx_areas")
TABLES["fx_pieces"] = """
SELECT area_id, wwtp, COUNT(*) * 4.0 AS intersect_area FROM fx_area_cells a JOIN fx_site_cells s ON a.cx = s.cx AND a.cy = s.cy GROUP BY 1, 2"""
TABLES["fx_area_weights"] = """
SELECT p.area_id, p.wwtp, intersect_area, area, population, county_fips, least(greatest(intersect_area / area, 0), 1) AS covered_prop,
 1 - least(greatest(intersect_area / area, 0), 1) AS outside_prop FROM fx_pieces p JOIN fx_areas a ON p.area_id = a.area_id"""
TABLES["fx_site_county"] = """
SELECT wwtp, county_fips, pop, pop / NULLIF(SUM(pop) OVER (PARTITION BY wwtp), 0) AS pct_of_utility, pop / NULLIF(c, 0) AS pct_of_county FROM
 (SELECT wwtp, county_fips, SUM(population * covered_prop) AS pop FROM fx_area_weights GROUP BY 1, 2) JOIN
 (SELECT county_fips, SUM(population) AS c FROM fx_areas GROUP BY 1) USING (county_fips)"""
TABLES["fx_dominant"] = """
SELECT wwtp, county_fips, ROUND(pct_of_utility, 9) AS pct_of_utility FROM (SELECT *, row_number() OVER (PARTITION BY wwtp ORDER BY ROUND(pct_of_utility, 9) DESC NULLS LAST, county_fips) AS rn FROM fx_site_county) WHERE rn = 1"""
TABLES["fx_site_cbsa"] = """
SELECT s.wwtp, cbsa, name, lsad, CASE WHEN cbsa IS NULL THEN 'Outside' WHEN lsad = 'M1' THEN 'Metro' WHEN lsad = 'M2' THEN 'Micro' ELSE 'Other CBSA' END AS cbsa_type,
 cbsa IS NOT NULL AS in_cbsa FROM fx_sites s LEFT JOIN fx_cbsa c ON s.x > c.x - c.h AND s.x <= c.x + c.h AND s.y > c.y - c.h AND s.y <= c.y + c.h"""
TABLES["fx_metro"] = """
SELECT DISTINCT t.county_fips FROM fx_county_tiles t JOIN fx_cbsa c ON t.px > c.x - c.h AND t.px <= c.x + c.h AND t.y > c.y - c.h AND t.y <= c.y + c.h"""


def site_shapes(spark, sf):
    """(cells of the distinct shapes of sites, members)."""
    rings, members = areal.shapes(dt.site_polygons(spark, sf), "wwtp")
    return areal.staged_cells(rings, CELL, "wwtp"), members


def polygon_order(spark, sf, feats, full=False):
    cells, members = site_shapes(spark, sf)
    return baselines.greedy_new_polygon_area(cells, feats, CELL * CELL, N, full, members)


def _area_shapes(spark, sf):
    """(cells of the distinct shapes of areas, classes of areas, the class of each area)."""
    rings, members = areal.shapes(dt.areas(spark, sf), "area_id", "area", "county_fips", "population")
    return areal.staged_cells(rings, CELL, "area_id"), *areal.area_classes(members)


def class_weights(spark, sf):
    """(weights between classes of areas and shapes of sites, classes of areas, class of each area, members of site shapes).

    ``area`` and ``population`` are of one area, ``copies`` counts the areas of a class.
    """
    cells, classes, member = _area_shapes(spark, sf)
    site, sites = site_shapes(spark, sf)
    pieces = stage(areal.overlap_area(cells, site, CELL)).withColumnRenamed("area_id", "shape")
    pieces = pieces.join(classes.select("shape", "area_id"), "shape").drop("shape")
    return stage(areal.area_weights(pieces, classes)), classes, member, sites


def weights(spark, sf):
    """Weights of every area and site."""
    w, _, member, sites = class_weights(spark, sf)
    each = areal.expand_shapes(w.drop("population"), member.withColumnRenamed("class", "shape"), "area_id")
    return areal.expand_shapes(each, sites, "wwtp")


def folded_weights(spark, sf):
    """(weights of classes whose areas and populations are those of all copies, classes of areas, members of site shapes)."""
    w, classes, _, sites = class_weights(spark, sf)
    w = w.join(classes.select("area_id", "copies"), "area_id").withColumn("area", F.col("area") * F.col("copies"))
    return w, classes, sites


def site_county(spark, sf):
    """Population of every site by county: found for shapes, then told to their members."""
    w, classes, sites = folded_weights(spark, sf)
    return areal.utility_county(w, classes), sites


def union_shares(spark, sf):
    """Share of each class of areas that any site covers, with the population of all its areas."""
    cells, classes, _ = _area_shapes(spark, sf)
    shares = areal.union_share(cells, site_shapes(spark, sf)[0], classes.withColumnRenamed("area_id", "_c").withColumnRenamed("shape", "area_id"), CELL)
    return shares.withColumnRenamed("area_id", "shape").withColumnRenamed("_c", "area_id")


@register("G1_rasterize", "wwtp:s cx:i cy:i", "SELECT * FROM fx_site_cells")
def _g1(spark, sf):
    return areal.rasterize(dt.site_polygons(spark, sf), CELL, "wwtp")


@register("G1_overlap_area", "area_id:s wwtp:s intersect_area:f", "SELECT * FROM fx_pieces")
def _g1o(spark, sf):
    areas, members = areal.shapes(dt.areas(spark, sf), "area_id")
    cells, sites = site_shapes(spark, sf)
    pieces = stage(areal.overlap_area(areal.rasterize(areas, CELL, "area_id"), cells, CELL))
    return areal.expand_shapes(areal.expand_shapes(pieces, members, "area_id"), sites, "wwtp")


@register("G2_area_weights", "area_id:s wwtp:s intersect_area:f covered_prop:r outside_prop:r", "SELECT * FROM fx_area_weights")
def _g2(spark, sf):
    return weights(spark, sf)


@register(
    "G3_site_served", "wwtp:s pop_served:f area_served:f",
    "SELECT wwtp, SUM(population * covered_prop) AS pop_served, SUM(area * covered_prop) AS area_served FROM fx_area_weights GROUP BY 1",
)
def _g3(spark, sf):
    w, _, sites = folded_weights(spark, sf)
    return areal.expand_shapes(areal.site_served(w), sites, "wwtp")


TABLES["fx_union_share"] = """
SELECT a.area_id, a.county_fips, a.population, least(COALESCE(n, 0) * 4.0 / area, 1) AS covered_prop FROM fx_areas a LEFT JOIN
 (SELECT area_id, COUNT(*) AS n FROM fx_area_cells WHERE (cx, cy) IN (SELECT (cx, cy) FROM fx_site_cells) GROUP BY 1) u ON a.area_id = u.area_id"""
TABLES["fx_uncovered"] = """
SELECT county_fips, round_even(SUM(population * (1 - covered_prop)), 0) AS uncovered_pop FROM fx_union_share GROUP BY 1"""


@register("G4_uncovered_population", "county_fips:s uncovered_pop:i", "SELECT * FROM fx_uncovered")
def _g4(spark, sf):
    return areal.uncovered_population(union_shares(spark, sf))


@register(
    "G4_uncovered_population_summed", "county_fips:s uncovered_pop:i",
    """SELECT county_fips, round_even(SUM(population * (1 - COALESCE(c, 0))), 0) AS uncovered_pop FROM fx_areas a LEFT JOIN
       (SELECT area_id, least(1.0, SUM(covered_prop)) AS c FROM fx_area_weights GROUP BY 1) w ON a.area_id = w.area_id GROUP BY 1""",
)
def _g4s(spark, sf):
    w, classes, sites = folded_weights(spark, sf)
    same = sites.groupBy(F.col("shape").alias("wwtp")).agg(F.count(F.lit(1)).alias("_m"))
    w = w.join(same, "wwtp").withColumn("covered_prop", F.col("covered_prop") * F.col("_m"))
    return areal.uncovered_population(areal.summed_share(w, classes))


@register("G5_utility_county", "wwtp:s county_fips:s pop:f pct_of_utility:r pct_of_county:r", "SELECT * FROM fx_site_county")
def _g5(spark, sf):
    return areal.expand_shapes(*site_county(spark, sf), "wwtp")


@register(
    "G6_assign_by_center", "area_id:s county_fips:s",
    """SELECT a.area_id, MIN(t.county_fips) AS county_fips FROM fx_areas a JOIN fx_county_tiles t
       ON a.x > t.x - t.h AND a.x <= t.x + t.h AND a.y > t.y - t.h AND a.y <= t.y + t.h GROUP BY 1""",
)
def _g6(spark, sf):
    return areal.assign_by_center(dt.areas(spark, sf), dt.county_polygons(spark, sf), 200.0)


@register("G7_assign_cbsa", "wwtp:s cbsa:s name:s lsad:s cbsa_type:s in_cbsa:b", "SELECT * FROM fx_site_cbsa")
def _g7(spark, sf):
    return areal.assign_cbsa(dt.sites(spark, sf), dt.cbsa_polygons(spark, sf), 100.0)


@register("G8_metro_counties", "county_fips:s", "SELECT * FROM fx_metro")
def _g8(spark, sf):
    return areal.metro_counties(dt.county_polygons(spark, sf), dt.cbsa_polygons(spark, sf), 100.0)


@register(
    "G9_site_radius", "wwtp:s radius:f",
    """SELECT s.wwtp, r * 1609.34 AS radius FROM fx_sites s LEFT JOIN (SELECT wwtp, AVG(10.0 + k) AS r FROM
       (SELECT DISTINCT c.wwtp, t.k FROM fx_site_cells c JOIN (SELECT *, CAST(k AS INTEGER) FROM fx_county_tiles) t
        ON (c.cx + 0.5) * 2 > t.x - 100 AND (c.cx + 0.5) * 2 < t.x + 100 AND (c.cy + 0.5) * 2 > t.y - 100 AND (c.cy + 0.5) * 2 < t.y + 100) GROUP BY 1) m ON s.wwtp = m.wwtp""",
)
def _g9(spark, sf):
    tiles = dt.county_polygons(spark, sf)
    zips = areal.rasterize(tiles.withColumnRenamed("county_fips", "zip"), CELL, "zip")
    commute = tiles.select(F.col("county_fips").alias("zip"), (F.lit(10.0) + F.col("k")).alias("miles"))
    cells, sites = site_shapes(spark, sf)
    return areal.expand_shapes(areal.site_radius(cells, zips, commute), sites, "wwtp")


@register("F12_dominant_county", "wwtp:s county_fips:s pct_of_utility:r", "SELECT * FROM fx_dominant WHERE pct_of_utility IS NOT NULL")
def _f12(spark, sf):
    share, sites = site_county(spark, sf)
    return areal.expand_shapes(areal.dominant_county(share.filter(F.col("pct_of_utility").isNotNull())), sites, "wwtp")


@register(
    "F13_county_alias", "wwtp:s county_name:s alias:s",
    """SELECT wwtp, n_name AS county_name, CASE WHEN COUNT(*) OVER (PARTITION BY n_name) > 1 THEN n_name || ' ' ||
       CASE WHEN rn >= 26 THEN chr(CAST(64 + rn // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + rn % 26 AS INTEGER)) ELSE n_name END AS alias
       FROM (SELECT CAST(s_suppkey AS VARCHAR) AS wwtp, n_name, row_number() OVER (PARTITION BY n_name ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS rn
             FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
)
def _f13(spark, sf):
    names = dt.county_polygons(spark, sf).select("county_fips", F.regexp_replace("county_name", " County$", "").alias("county_name"))
    return areal.county_alias(dt.sites(spark, sf).join(names, "county_fips"))


# ---------------------------------------------------------------- selection


def _graph(spark, sf):
    s = half_sites(spark, sf)
    return graph.components(s, graph.component_edges(s)), graph.nearest_other(s)


def _select_inputs(ranks: str, pairs: str, cols: list[str], risk: str | None = None) -> list[str]:
    """CTEs of what the rules look at, by part ``p``, and of the counties of each site."""
    mean = " + ".join(f"COALESCE({c}, 0)" for c in cols)
    known = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    mm = lambda c: f"COALESCE(({c} - MIN({c}) OVER w) / NULLIF(MAX({c}) OVER w - MIN({c}) OVER w, 0), 0)"
    top = " OR ".join(f"COALESCE({c} <= ceil(0.3 * COUNT({c}) OVER w), FALSE)" for c in cols)
    low = " AND ".join(f"COALESCE({c} >= floor(0.8 * COUNT({c}) OVER w), TRUE)" for c in cols)
    half = " AND ".join(f"ROUND({m}, 6) < ROUND(MEDIAN({m}) OVER w, 6)" for m in M)
    # the scale of the inverse risk skips nulls, and a null there leaves no score at all
    inverse = f"CASE WHEN MAX(1.0 / {risk}) OVER w > MIN(1.0 / {risk}) OVER w THEN ((1.0 / {risk}) - MIN(1.0 / {risk}) OVER w) / (MAX(1.0 / {risk}) OVER w - MIN(1.0 / {risk}) OVER w) ELSE 0 END" if risk else "0"
    return [
        f"""si_base AS MATERIALIZED (SELECT r.*, component, nearest_km, t.score AS diffusion_score, ({mean}) / CAST({known} AS DOUBLE) AS mean_rank,
          COUNT(*) OVER (PARTITION BY p, component) AS size FROM ({ranks}) r JOIN fx_components c ON r.wwtp = c.wwtp JOIN fx_nearest n ON r.wwtp = n.wwtp
          LEFT JOIN (SELECT wwtp, score FROM fx_scores ORDER BY score DESC, wwtp LIMIT {N}) t ON r.wwtp = t.wwtp)""",
        f"""si AS MATERIALIZED (SELECT p, wwtp, component, size, nearest_km, diffusion_score, ROUND(mean_rank, 6) AS avg_rank,
          COALESCE((1 - {mm('mean_rank')}) + 0.5 * (0.5 * {mm('pop_served')} + 0.5 * {mm('pop_covered_by_od')}) + 0.5 * {inverse}
            + 0.5 * CASE WHEN nearest_km >= 100 THEN 1 ELSE 0 END, 0) AS importance,
          ({top}) AS top_any, ({low}) AND ({known}) > 0 AS bottom_all, {half} AS low_impact FROM si_base WINDOW w AS (PARTITION BY p))""",
        f"si_pairs AS MATERIALIZED ({pairs})",
    ]


def _select_sql(inputs: list[str], legacy: bool = True) -> str:
    """The whole selection, one pick per component and step, as the rules are told."""
    saturated = "seen AND gain >= 1" if legacy else "FALSE"
    late = "" if legacy else "WHEN gain >= 1 THEN 'saturation_component'"
    ctes = [*inputs, f"""si_one AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ROUND(importance, 6) DESC, avg_rank, wwtp) <= 6 AS res,
        (low_impact OR (NOT top_any AND nearest_km <= 100)) AND (diffusion_score IS NULL OR bottom_all) AS gone FROM si WHERE size = 1)""",
        """si_multi AS MATERIALIZED (SELECT s.*, c.counties, greatest(1, CAST(ceil(0.25 * size) AS BIGINT)) AS quota,
          CASE WHEN diffusion_score IS NOT NULL AND size >= 3 THEN row_number() OVER (PARTITION BY s.p, component, diffusion_score IS NULL ORDER BY diffusion_score DESC, avg_rank, s.wwtp) END AS k
          FROM si s LEFT JOIN (SELECT p, wwtp, list(county) AS counties FROM si_pairs GROUP BY 1, 2) c ON s.p = c.p AND s.wwtp = c.wwtp WHERE size > 1)""",
        """si_first AS MATERIALIZED (SELECT p, component, any_value(quota) AS quota, COALESCE(list(wwtp) FILTER (k <= quota), []) AS chosen,
          COALESCE(list_distinct(flatten(list(COALESCE(counties, [])) FILTER (k <= quota))), []) AS covered FROM si_multi GROUP BY 1, 2)""",
        f"""si_greedy AS MATERIALIZED (WITH RECURSIVE g AS (
          SELECT p, component, quota, NULL::VARCHAR AS wwtp, 0::BIGINT AS gain, NULL::VARCHAR AS method, FALSE AS seen, len(chosen) AS pick, chosen, covered FROM si_first
          UNION ALL
          SELECT p, component, quota, wwtp, gain, method, seen OR method = 'coverage_gain', pick + 1, list_append(chosen, wwtp), list_distinct(list_concat(covered, counties)) FROM (
            SELECT *, CASE WHEN {saturated} THEN 'saturation_component' WHEN pick < quota THEN 'coverage_gain' {late} END AS method FROM (
              SELECT *, row_number() OVER (PARTITION BY p, component ORDER BY gain DESC, avg_rank, wwtp) AS rn FROM (
                SELECT g.p, g.component, g.quota, g.seen, g.pick, g.chosen, g.covered, s.wwtp, s.avg_rank, COALESCE(s.counties, []) AS counties,
                  len(list_filter(COALESCE(s.counties, []), lambda c: NOT list_contains(g.covered, c))) AS gain
                FROM g JOIN si_multi s ON g.p = s.p AND g.component = s.component WHERE NOT list_contains(g.chosen, s.wwtp))) WHERE rn = 1)
          WHERE method IS NOT NULL) SELECT * FROM g)""",
        "si_last AS (SELECT p, component, arg_max(covered, pick) AS covered FROM si_greedy GROUP BY 1, 2)",
        """si_picked AS (SELECT p, wwtp, pick, gain, method FROM si_greedy WHERE wwtp IS NOT NULL
          UNION ALL SELECT p, wwtp, k, len(COALESCE(counties, [])), 'diffusion_priority' FROM si_multi WHERE k <= quota)""",
    ]
    body = """
      SELECT p AS year_month, wwtp, component, size AS component_size, avg_rank, importance, CASE WHEN res OR NOT gone THEN 'keep' ELSE 'drop' END AS decision,
        CASE WHEN res THEN 'reserved' WHEN gone THEN 'pruning_rule' WHEN diffusion_score IS NOT NULL AND NOT bottom_all THEN 'diffusion_singleton' ELSE 'singleton_pass' END AS method,
        CASE WHEN res THEN 'reserved_singleton'
          WHEN gone THEN concat_ws(' | ', CASE WHEN low_impact THEN 'low_impact' END, CASE WHEN NOT top_any AND nearest_km <= 100 THEN 'near another and top in nothing' END,
            CASE WHEN diffusion_score IS NOT NULL AND bottom_all THEN 'in diffusion, bottom everywhere' END)
          ELSE concat_ws(' | ', CASE WHEN diffusion_score IS NOT NULL AND NOT bottom_all THEN 'in diffusion' END, CASE WHEN NOT low_impact THEN 'has impact' END,
            CASE WHEN top_any THEN 'top in a metric' END, CASE WHEN nearest_km > 100 THEN 'isolated' END) END AS reason,
        NULL::BIGINT AS pick, NULL::BIGINT AS coverage_gain, NULL::BIGINT AS residual_gain, res AS selected FROM si_one
      UNION ALL
      SELECT s.p, s.wwtp, s.component, size, avg_rank, importance, CASE WHEN k.method IS NULL THEN 'not_chosen' ELSE 'keep' END, COALESCE(k.method, 'not taken'),
        CASE k.method WHEN 'diffusion_priority' THEN 'high score, within the quota' WHEN 'saturation_component' THEN 'at least 1 new counties'
          WHEN 'coverage_gain' THEN 'new counties, then rank' ELSE 'others of its component came first' END,
        k.pick, k.gain, CASE WHEN k.method IS NULL THEN len(list_filter(COALESCE(s.counties, []), lambda c: NOT list_contains(l.covered, c))) END, k.method IS NOT NULL
      FROM si_multi s JOIN si_last l ON s.p = l.p AND s.component = l.component LEFT JOIN si_picked k ON s.p = k.p AND s.wwtp = k.wwtp"""
    return f"WITH {', '.join(ctes)} {body}"


_RANKED = [f"rank_{m}" for m in M]
_MONTH_PAIRS = f"SELECT DISTINCT {_YM} AS p, wwtp, county_fips AS county FROM fx_edges"
_ALL_RANKS = "SELECT 'all' AS p, * FROM fx_ranks"
_MONTH_RANKS = "SELECT year_month AS p, * FROM fx_ranks_month"
_RISK_RANKS = """SELECT r.year_month AS p, r.*, rank_combined_risk FROM fx_ranks_month r
  LEFT JOIN fx_risk_rank k ON r.year_month = k.year_month AND r.wwtp = k.wwtp"""
TABLES["fx_selection_month"] = _select_sql(_select_inputs(_MONTH_RANKS, _MONTH_PAIRS, _RANKED))
TABLES["fx_selection_quota"] = _select_sql(_select_inputs(_MONTH_RANKS, _MONTH_PAIRS, _RANKED), legacy=False)
TABLES["fx_selection_risk"] = _select_sql(_select_inputs(_RISK_RANKS, _MONTH_PAIRS, [*_RANKED, "rank_combined_risk"], "rank_combined_risk"))
TABLES["fx_selection"] = _select_sql(_select_inputs(_ALL_RANKS, "SELECT DISTINCT 'all' AS p, wwtp, county_fips AS county FROM fx_edges", _RANKED))
TABLES["fx_budget"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tier, avg_rank, wwtp) AS ord FROM (SELECT *,
 CASE WHEN selected AND method = 'reserved' THEN 0 WHEN component_size = 1 AND decision = 'keep' AND selected THEN 1
   WHEN selected AND method <> 'saturation_component' THEN 2 WHEN selected THEN 3 ELSE 4 END AS tier FROM fx_selection)) WHERE ord <= {N}"""


def _site_counties(coverage, *parts):
    return coverage.select(*parts, "wwtp", F.explode(F.array_union("counties_in", "counties_out")).alias("county_fips"))


def selected_month(spark, sf, params=selection.SelectionParams(), risk: bool = False):
    """Selection of every month in one job."""
    edges = stage_table(dt.weekly_edges(spark, sf)) if risk else None  # the signal reads them too
    cover = stage(month_coverage(spark, sf, edges))
    feats = stage(graph.feature_table(dt.sites(spark, sf), cover, ["year_month"]))
    signal = stage_table(monthly_risk_signal(summary(spark, sf, edges))) if risk else None
    ranks = stage(ranking.month_rank_table(feats, signal, parts=["year_month"]))
    comps, near = _graph(spark, sf)
    table = selection.site_table(feats, ranks, comps, near, top_scores(spark, sf), ["year_month"], params)
    return selection.select_sites(table, _site_counties(cover, "year_month"), ["year_month"], params)


def top_scores(spark, sf):
    """The exported list of the sites with the highest scores."""
    from netreach.plans.ordering import top_rows

    return top_rows(dt.scores(spark, sf), [F.desc("score"), F.col("wwtp")], N)


def shared_tables(spark, sf):
    """(coverage, features, components) of the sites, staged: what a network and its evaluation both read."""
    cover = stage(graph.od_coverage(dt.weekly_edges(spark, sf)))
    s = half_sites(spark, sf)
    comps = stage(graph.components(s, graph.component_edges(s)))
    return cover, stage(graph.feature_table(dt.sites(spark, sf), cover)), comps


def whole_selection(spark, sf, shared=None, ranks=None):
    """Selection over all months together; ``shared_tables`` and ranks that the caller has are not built again."""
    cover, feats, comps = shared or shared_tables(spark, sf)
    ranks = stage(ranking.month_rank_table(feats)) if ranks is None else ranks
    near = graph.nearest_other(half_sites(spark, sf))
    table = selection.site_table(feats, ranks, comps, near, top_scores(spark, sf))
    return stage(selection.select_sites(table, _site_counties(cover)))


_X1 = "year_month:s wwtp:s decision:s method:s pick:i coverage_gain:i residual_gain:i selected:b"


@register("X1_select_sites", _X1, "SELECT * FROM fx_selection_month")
def _x1(spark, sf):
    return selected_month(spark, sf)


@register("X1_select_sites_quota_first", _X1, "SELECT * FROM fx_selection_quota")
def _x1_quota(spark, sf):
    return selected_month(spark, sf, selection.SelectionParams(legacy_saturation=False))


@register("X1_select_sites_risk", _X1, "SELECT * FROM fx_selection_risk")
def _x1_risk(spark, sf):
    return selected_month(spark, sf, risk=True)


@register("X2_decision_log", "year_month:s wwtp:s decision:s method:s reason:s component:s component_size:i avg_rank:f", "SELECT * FROM fx_selection_month")
def _x2(spark, sf):
    return selection.decision_log(selected_month(spark, sf))


@register(
    "X8_singleton_report", "year_month:s wwtp:s status:s reason:s reserved:b selected:b avg_rank:f importance:r",
    """SELECT *, CASE WHEN decision = 'keep' THEN 'kept' ELSE 'dropped' END AS status, method = 'reserved' AS reserved
       FROM fx_selection_month WHERE component_size = 1""",
)
def _x8(spark, sf):
    return selection.singleton_report(selected_month(spark, sf))


@register("X3_trim_to_budget", "ord:i wwtp:s tier:i method:s", "SELECT * FROM fx_budget")
def _x3(spark, sf):
    return selection.trim_to_budget(whole_selection(spark, sf), N)


TABLES["fx_expanded"] = """
SELECT row_number() OVER (ORDER BY p, s) AS ord, wwtp, phase FROM (
 SELECT wwtp, 'baseline' AS phase, 0 AS p, ord AS s FROM fx_budget
 UNION ALL SELECT wwtp, 'saturation', 1, row_number() OVER (ORDER BY avg_rank, wwtp) FROM fx_selection WHERE selected AND wwtp NOT IN (SELECT wwtp FROM fx_budget)
 UNION ALL SELECT wwtp, 'backforth', 2, CASE WHEN component_size = 1 THEN (i - 1) * 3 ELSE ((i - 1) // 2) * 3 + 1 + (i - 1) % 2 END FROM (
  SELECT *, row_number() OVER (PARTITION BY component_size = 1 ORDER BY avg_rank, wwtp) AS i FROM fx_selection
  WHERE NOT selected AND wwtp NOT IN (SELECT wwtp FROM fx_budget)))"""


@register("X4_expand_order", "ord:i wwtp:s phase:s", "SELECT * FROM fx_expanded WHERE ord <= 70")
def _x4(spark, sf):
    s = whole_selection(spark, sf)
    return selection.expand_order(selection.trim_to_budget(s, N), s)


TABLES["fx_tagged"] = """
SELECT s.wwtp, selected, t.wwtp IS NOT NULL AS in_top_scores, CASE WHEN t.wwtp IS NULL THEN 'none' WHEN selected AND component_size = 1 THEN 'reinforced_singleton'
  WHEN selected THEN 'reinforced_component' WHEN component_size = 1 THEN 'normal_singleton' ELSE 'normal_component_redundant' END AS tag
FROM fx_selection s LEFT JOIN (SELECT wwtp FROM fx_scores ORDER BY score DESC, wwtp LIMIT 20) t ON s.wwtp = t.wwtp"""


def tagged(spark, sf):
    return selection.tag_post_selection(whole_selection(spark, sf), dt.scores(spark, sf), 20)


def official(spark, sf):
    return dt.sites(spark, sf).filter(F.col("act_sts").startswith("sentinel"))


@register("X5_tag_post_selection", "wwtp:s selected:b in_top_scores:b tag:s", "SELECT * FROM fx_tagged")
def _x5(spark, sf):
    return tagged(spark, sf)


_OFF = "(SELECT wwtp FROM fx_sites WHERE act_sts LIKE 'sentinel%')"


@register(
    "X6_site_categories", "wwtp:s selected:b in_top_scores:b official:b official_not_selected:b",
    f"SELECT *, wwtp IN {_OFF} AS official, wwtp IN {_OFF} AND NOT selected AS official_not_selected FROM fx_tagged",
)
def _x6(spark, sf):
    return selection.site_categories(tagged(spark, sf), official(spark, sf))


@register(
    "X6_category_counts", "n_selected:i n_in_top_scores:i n_official:i n_official_not_selected:i",
    f"""SELECT COUNT(*) FILTER (selected) AS n_selected, COUNT(*) FILTER (in_top_scores) AS n_in_top_scores,
        COUNT(*) FILTER (wwtp IN {_OFF}) AS n_official, COUNT(*) FILTER (wwtp IN {_OFF} AND NOT selected) AS n_official_not_selected FROM fx_tagged""",
)
def _x6c(spark, sf):
    return selection.category_counts(selection.site_categories(tagged(spark, sf), official(spark, sf)))


@register(
    "X7_existing_sites", "ord:i wwtp:s",
    "SELECT row_number() OVER (ORDER BY ord, wwtp) AS ord, wwtp FROM fx_sites WHERE act_sts LIKE 'sentinel%' ORDER BY ord LIMIT 20",
)
def _x7(spark, sf):
    return selection.existing_sites(dt.sites(spark, sf), N)


@register("X9_reuse_order", "ord:i wwtp:s", "SELECT ord, wwtp FROM fx_order WHERE ord <= 20")
def _x9(spark, sf):
    o = ranking.order_by_rank(ranking.month_rank_table(features(spark, sf))).select(
        F.lit("Ours level 1").alias("strategy"), F.col("ord").alias("site_order"), "wwtp")
    return selection.reuse_order(o, N)


# ---------------------------------------------------------------- baselines


@register("B1_population_order", "ord:i wwtp:s", "SELECT ord, wwtp FROM fx_orders WHERE strategy = 'population' AND ord <= 20")
def _b1(spark, sf):
    return baselines.population_order(features(spark, sf), N)


def _greedy_sql(pairs: str, tie: str, n: int) -> str:
    """n unrolled rounds: best site, then the pairs it leaves uncovered."""
    ctes = [f"p0 AS MATERIALIZED ({pairs})", f"tie AS MATERIALIZED ({tie})"]
    for i in range(1, n + 1):
        ctes.append(f"r{i} AS MATERIALIZED (SELECT g.wwtp, gain FROM (SELECT wwtp, ROUND(SUM(mass), 6) AS gain FROM p{i-1} GROUP BY 1) g JOIN tie t ON g.wwtp = t.wwtp ORDER BY gain DESC, ROUND(tie, 9) DESC, g.wwtp LIMIT 1)")
        ctes.append(f"p{i} AS MATERIALIZED (SELECT * FROM p{i-1} WHERE item NOT IN (SELECT item FROM p{i-1} WHERE wwtp = (SELECT wwtp FROM r{i})))")
    rows = " UNION ALL ".join(f"SELECT {i} AS ord, wwtp, gain FROM r{i}" for i in range(1, n + 1))
    return f"WITH {', '.join(ctes)} {rows}"


TABLES["fx_area_tie"] = (
    "SELECT wwtp, a + 0.01 * p + 0.0001 * v AS tie FROM (SELECT wwtp, "
    + ", ".join(f"COALESCE(({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 0) AS {t}"
                for c, t in (("area_reached", "a"), ("pop_covered_by_od", "p"), ("od_volume_total", "v")))
    + " FROM fx_features)"
)
TABLES["fx_greedy_area"] = _greedy_sql(
    "SELECT wwtp, bg_fips AS item, MAX(MAX(area)) OVER (PARTITION BY bg_fips) AS mass FROM fx_links WHERE direction = 'Destination' GROUP BY wwtp, bg_fips",
    "SELECT * FROM fx_area_tie", N)
TABLES["fx_greedy_cells"] = _greedy_sql(
    "SELECT wwtp, CAST(cx AS VARCHAR) || ':' || CAST(cy AS VARCHAR) AS item, 4.0 AS mass FROM fx_site_cells",
    "SELECT wwtp, pop_served AS tie FROM fx_features", N)


@register(
    "B2_greedy_new_area", "ord:i wwtp:s gain:f",
    f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY COALESCE(g.ord, 1000000000), l.wwtp IS NULL, CASE WHEN l.wwtp IS NULL THEN -ROUND(area_reached, 6) ELSE -ROUND(tie, 9) END, f.wwtp) AS ord,
        f.wwtp, COALESCE(gain, 0) AS gain FROM fx_features f JOIN fx_area_tie t ON f.wwtp = t.wwtp LEFT JOIN fx_greedy_area g ON f.wwtp = g.wwtp
        LEFT JOIN (SELECT DISTINCT wwtp FROM fx_links WHERE direction = 'Destination') l ON f.wwtp = l.wwtp) WHERE ord <= {N}""",
)
def _b2(spark, sf):
    return baselines.greedy_new_area(dt.bg_links(spark, sf), features(spark, sf), N)


@register(
    "B3_greedy_new_polygon_area", "ord:i wwtp:s gain:f",
    f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY COALESCE(g.ord, 1000000000), ROUND(pop_served, 6) DESC, f.wwtp) AS ord, f.wwtp, COALESCE(gain, 0) AS gain
        FROM fx_features f LEFT JOIN fx_greedy_cells g ON f.wwtp = g.wwtp) WHERE ord <= {N}""",
)
def _b3(spark, sf):
    return polygon_order(spark, sf, features(spark, sf))


TABLES["fx_scored"] = """
SELECT f.wwtp, x, y, cbsa, lsad, ROUND((f.pop_served - MIN(f.pop_served) OVER ()) / (MAX(f.pop_served) OVER () - MIN(f.pop_served) OVER ()), 9) AS score
FROM fx_features f JOIN fx_sites s ON f.wwtp = s.wwtp JOIN fx_site_cbsa c ON f.wwtp = c.wwtp"""


def _spread_sql(cands: str, start: str, n: int, tag: str, base: str) -> list[str]:
    """CTEs of n farthest-first rounds after the sites of ``start`` (wwtp, x, y)."""
    ctes, prev = [], start
    for i in range(1, n + 1):
        ctes.append(
            f"{tag}{i} AS MATERIALIZED (SELECT c.wwtp, c.x, c.y FROM {cands} c CROSS JOIN ({prev}) s WHERE c.wwtp NOT IN (SELECT wwtp FROM ({prev})) "
            f"GROUP BY c.wwtp, c.x, c.y, c.score ORDER BY ROUND(MIN(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))), 6) DESC, c.score DESC, c.wwtp DESC LIMIT 1)")
        prev = " UNION ALL ".join([start] + [f"SELECT * FROM {tag}{j}" for j in range(1, i + 1)])
    return ctes


def _farthest_sql(n: int) -> str:
    first = """f0 AS MATERIALIZED (SELECT c.wwtp, c.x, c.y FROM fx_scored c JOIN fx_scored o ON c.wwtp <> o.wwtp GROUP BY c.wwtp, c.x, c.y, c.score
      ORDER BY ROUND(AVG(sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y))), 6) DESC, c.score DESC, c.wwtp DESC LIMIT 1)"""
    ctes = [first] + _spread_sql("fx_scored", "SELECT * FROM f0", n - 1, "f", "f0")
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS ord, wwtp FROM f{i}" for i in range(n))
    return f"WITH {', '.join(ctes)} {rows}"


@register("B5_farthest_first", "ord:i wwtp:s", _farthest_sql(N))
def _b5(spark, sf):
    d = _scored(spark, sf)
    return baselines.farthest_first(d, None, N)


def _scored(spark, sf):
    from netreach.functions.scaling import minmax

    f = minmax(features(spark, sf).select("wwtp", "pop_served"), {"pop_served": "score"})
    return f.join(dt.sites(spark, sf).select("wwtp", "x", "y"), "wwtp").select("wwtp", "x", "y", F.round("score", 9).alias("score"))


def _cbsa_sql(n: int) -> str:
    """Representatives first; the unrolled spread is long enough for a network with one of them."""
    reps = f"""reps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CASE lsad WHEN 'M1' THEN 0 WHEN 'M2' THEN 1 ELSE 2 END, total DESC, score DESC, wwtp) AS ord, wwtp, x, y FROM
      (SELECT *, ROUND(SUM(score) OVER (PARTITION BY cbsa), 6) AS total, row_number() OVER (PARTITION BY cbsa ORDER BY score DESC, wwtp) AS rn FROM fx_scored WHERE cbsa IS NOT NULL)
      WHERE rn = 1)"""
    ctes = [reps, "outside AS MATERIALIZED (SELECT * FROM fx_scored WHERE cbsa IS NULL)"]
    ctes += _spread_sql("outside", "SELECT wwtp, x, y FROM reps", n, "f", "reps")
    rows = "SELECT ord, wwtp, 'cbsa_representative' AS source FROM reps" + "".join(
        f" UNION ALL SELECT (SELECT COUNT(*) FROM reps) + {i}, wwtp, 'farthest_outside_cbsa' FROM f{i}" for i in range(1, n + 1))
    return f"WITH {', '.join(ctes)} SELECT * FROM ({rows}) WHERE ord <= {n}"


TABLES["fx_cbsa_order"] = _cbsa_sql(N)


@register("B4_cbsa_order", "ord:i wwtp:s source:s", "SELECT * FROM fx_cbsa_order")
def _b4(spark, sf):
    f = features(spark, sf)
    assigned = areal.assign_cbsa(dt.sites(spark, sf), dt.cbsa_polygons(spark, sf), 100.0)
    return baselines.cbsa_order(f, dt.sites(spark, sf), assigned, N)


@register(
    "B6_single_metric_orders", "strategy:s ord:i wwtp:s",
    """SELECT 'area_only' AS strategy, row_number() OVER (ORDER BY ROUND(area_reached, 6) DESC, wwtp) AS ord, wwtp FROM fx_features QUALIFY ord <= 20
       UNION ALL SELECT 'mobility_only', row_number() OVER (ORDER BY ROUND(od_volume_total, 6) DESC, wwtp) AS ord, wwtp FROM fx_features QUALIFY ord <= 20
       UNION ALL SELECT 'ej_only', row_number() OVER (ORDER BY COALESCE(score, 0) DESC, f.wwtp) AS ord, f.wwtp FROM fx_features f LEFT JOIN fx_scores s ON f.wwtp = s.wwtp QUALIFY ord <= 20""",
)
def _b6(spark, sf):
    f = features(spark, sf)
    s = f.select("wwtp").join(dt.scores(spark, sf), "wwtp", "left")
    return baselines.full_orders({
        "area_only": baselines.single_metric_order(f, "area_reached", N),
        "mobility_only": baselines.single_metric_order(f, "od_volume_total", N),
        "ej_only": baselines.single_metric_order(s, "score", N),
    })


TABLES["fx_full_level1"] = """
SELECT row_number() OVER (ORDER BY COALESCE(b.ord, 1000000000), final_rank, r.wwtp) AS ord, r.wwtp FROM fx_ranks r LEFT JOIN fx_budget b ON r.wwtp = b.wwtp"""


@register("B7_full_level1_order", "ord:i wwtp:s", "SELECT * FROM fx_full_level1")
def _b7(spark, sf):
    shared = shared_tables(spark, sf)
    ranks = stage(ranking.month_rank_table(shared[1]))
    return baselines.full_level1_order(ranks, selection.trim_to_budget(whole_selection(spark, sf, shared, ranks), N))


def _spread_all_sql() -> str:
    """All sites after the representatives: those outside census areas first, each time the farthest one."""
    return """all_reps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CASE lsad WHEN 'M1' THEN 0 WHEN 'M2' THEN 1 ELSE 2 END, total DESC, score DESC, wwtp) AS ord, wwtp, x, y FROM
      (SELECT *, ROUND(SUM(score) OVER (PARTITION BY cbsa), 6) AS total, row_number() OVER (PARTITION BY cbsa ORDER BY score DESC, wwtp) AS rn FROM fx_scored WHERE cbsa IS NOT NULL)
      WHERE rn = 1),
    spread AS MATERIALIZED (WITH RECURSIVE g AS (
      SELECT COUNT(*) AS ord, NULL::VARCHAR AS wwtp, list(wwtp) AS names, list({'x': x, 'y': y}) AS points FROM all_reps
      UNION ALL
      SELECT ord + 1, wwtp, list_append(names, wwtp), list_append(points, {'x': x, 'y': y}) FROM (
        SELECT *, row_number() OVER (ORDER BY cbsa IS NOT NULL, d DESC, score DESC, wwtp DESC) AS rn FROM (
          SELECT g.ord, g.names, g.points, c.wwtp, c.x, c.y, c.cbsa, c.score,
            ROUND(list_min(list_transform(g.points, lambda p: sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)))), 6) AS d
          FROM g, fx_scored c WHERE NOT list_contains(g.names, c.wwtp))) WHERE rn = 1) SELECT ord, wwtp FROM g WHERE wwtp IS NOT NULL)"""


#: Sites of the largest network that the SQL of B8 unrolls its greedy cover for.
UNROLLED = 100
TABLES["fx_greedy_cells_all"] = _greedy_sql(
    "SELECT wwtp, CAST(cx AS VARCHAR) || ':' || CAST(cy AS VARCHAR) AS item, 4.0 AS mass FROM fx_site_cells",
    "SELECT wwtp, pop_served AS tie FROM fx_features", UNROLLED)


@register(
    "B8_full_orders", "strategy:s ord:i wwtp:s",
    f"""WITH {_spread_all_sql()}
    SELECT 'population' AS strategy, ord, wwtp FROM fx_orders WHERE strategy = 'population'
    UNION ALL SELECT 'polygon', row_number() OVER (ORDER BY COALESCE(g.ord, 1000000000), ROUND(pop_served, 6) DESC, f.wwtp), f.wwtp
      FROM fx_features f LEFT JOIN fx_greedy_cells_all g ON f.wwtp = g.wwtp
    UNION ALL SELECT 'cbsa', ord, wwtp FROM all_reps UNION ALL SELECT 'cbsa', ord, wwtp FROM spread
    UNION ALL SELECT 'level1', ord, wwtp FROM fx_full_level1""",
)
def _b8(spark, sf):
    shared = shared_tables(spark, sf)
    f = shared[1]
    assigned = areal.assign_cbsa(dt.sites(spark, sf), dt.cbsa_polygons(spark, sf), 100.0)
    ranks = stage(ranking.month_rank_table(f))
    return baselines.full_orders({
        "population": baselines.metric_order(f, "pop_served", "population"),
        "polygon": polygon_order(spark, sf, f, full=True),
        "cbsa": baselines.cbsa_order(f, dt.sites(spark, sf), assigned, None),
        "level1": baselines.full_level1_order(ranks, selection.trim_to_budget(whole_selection(spark, sf, shared, ranks), N)),
    })


TABLES["fx_top"] = f"""
SELECT 'population' AS strategy, ord, wwtp FROM fx_orders WHERE strategy = 'population' AND ord <= {N}
UNION ALL SELECT * FROM (SELECT 'polygon', row_number() OVER (ORDER BY COALESCE(g.ord, 1000000000), ROUND(pop_served, 6) DESC, f.wwtp) AS ord, f.wwtp
  FROM fx_features f LEFT JOIN fx_greedy_cells g ON f.wwtp = g.wwtp) WHERE ord <= {N}
UNION ALL SELECT 'cbsa', ord, wwtp FROM fx_cbsa_order
UNION ALL SELECT 'level1', ord, wwtp FROM fx_budget"""


def strategies(spark, sf, shared):
    """The networks that are compared: the largest sites, the widest area, one for each census area, and the selection."""
    sites, feats = dt.sites(spark, sf), shared[1]
    assigned = areal.assign_cbsa(sites, dt.cbsa_polygons(spark, sf), 100.0)
    return stage(baselines.full_orders({
        "population": baselines.population_order(feats, N),
        "polygon": polygon_order(spark, sf, feats),
        "cbsa": baselines.cbsa_order(feats, sites, assigned, N),
        "level1": selection.trim_to_budget(whole_selection(spark, sf, shared), N),
    }))
