"""Origin-destination aggregation and period statistics.

Weekly edges: (week, direction, wwtp, county_fips) -> volume, area, population, with
direction ``county_to_wwtp`` (inbound) or ``wwtp_to_county`` (outbound).  Absent cells mean
zero; they are counted analytically wherever a statistic needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from netreach.functions.expr import ratio
from netreach.functions.losses import observed
from netreach.functions.periods import add_period_fields
from netreach.plans.staging import stage, stage_table

INBOUND = "county_to_wwtp"
OUTBOUND = "wwtp_to_county"
MEASURES = ["volume", "area", "population"]
EDGE_KEY = ["week", "direction", "wwtp", "county_fips"]


def weekly_od(daily: DataFrame, losses: Observation | None = None) -> DataFrame:
    """Mean of the available daily records per week; a missing day is not a zero.

    Rows of no known direction, day, site or county are left out; ``losses`` counts them in the same pass.
    """
    dest = F.lower("direction") == "destination"
    rows = daily.select(
        F.date_trunc("week", "day").cast("date").alias("week"),
        F.when(dest, INBOUND).when(F.lower("direction") == "origin", OUTBOUND).alias("direction"),
        F.when(dest, F.col("sewershed_d")).otherwise(F.col("sewershed_o")).alias("wwtp"),
        F.col("county").alias("county_fips"),
        *MEASURES,
    )
    rows = observed(rows, losses, **{f"no_{c}": F.col(c).isNull() for c in EDGE_KEY})
    return rows.dropna(subset=EDGE_KEY).groupBy(*EDGE_KEY).agg(*[F.avg(m).alias(m) for m in MEASURES])


def weekly_cases(daily: DataFrame, label: str = "label", value: str = "rate") -> DataFrame:
    """Mean rate by (label, Monday)."""
    return daily.groupBy(label, F.date_trunc("week", "day").cast("date").alias("week")).agg(
        F.avg(value).alias(value)
    )


def collapse_edges(edges: DataFrame) -> DataFrame:
    """Sum duplicate edges; a measure that is null throughout stays null."""
    return edges.groupBy(*EDGE_KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _directed(direction: str, value: str = "volume") -> Column:
    return F.coalesce(F.sum(F.when(F.col("direction") == direction, F.col(value))), F.lit(0.0))


def weekly_totals(edges: DataFrame) -> DataFrame:
    """total_in, total_out, total_flow and net_flow (out - in) per (week, site)."""
    return (
        edges.groupBy("week", "wwtp")
        .agg(_directed(INBOUND).alias("total_in"), _directed(OUTBOUND).alias("total_out"))
        .withColumn("total_flow", F.col("total_in") + F.col("total_out"))
        .withColumn("net_flow", F.col("total_out") - F.col("total_in"))
    )


def ensure_outflow(totals: DataFrame) -> DataFrame:
    """Copy inflow to outflow in weeks without any outflow at all.

    The week sums are aggregated first and joined back, so one task never holds a week.
    """
    totals = stage_table(totals)
    weekly = stage_table(totals.groupBy("week").agg(F.coalesce(F.sum("total_out"), F.lit(0.0)).alias("_week_out")))  # a row for each week
    missing = F.col("_week_out") == 0
    out = totals.drop("total_flow", "net_flow").join(weekly, "week")
    return (
        out.withColumn("outflow_source", F.when(missing, "inflow_copy").otherwise("observed"))
        .withColumn("total_out", F.when(missing, F.col("total_in")).otherwise(F.col("total_out")))
        .drop("_week_out")
        .withColumn("total_flow", F.col("total_in") + F.col("total_out"))
        .withColumn("net_flow", F.col("total_out") - F.col("total_in"))
    )


def weekly_trip_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical (week, site) totals and the in/out table per (week, site, county).

    The second table holds one row per county ever linked to the site, zero where a week has
    no trip in a direction.
    """
    edges = stage(edges)
    totals = ensure_outflow(weekly_totals(edges))
    cells = (
        edges.groupBy("week", "wwtp", "county_fips")
        .agg(_directed(INBOUND).alias("inbound"), _directed(OUTBOUND).alias("outbound"))
    )
    weeks = edges.groupBy("wwtp").agg(F.collect_set("week").alias("_weeks"))
    grid = (
        edges.select("wwtp", "county_fips").distinct().join(weeks, "wwtp")
        .select("wwtp", "county_fips", F.explode("_weeks").alias("week"))
    )
    dense = grid.join(cells, ["week", "wwtp", "county_fips"], "left").fillna(0.0, ["inbound", "outbound"])
    return totals, dense.select("week", "wwtp", "county_fips", "inbound", "outbound")


_STATS = ["total_in", "total_out", "total_flow"]


def _spread(c: str) -> list[Column]:
    return [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]


def _weeks() -> Column:
    return F.count_distinct("week").alias("n_weeks")


GRAINS = {"month": "year_month", "quarter": "year_quarter", "season": "year_season", "year": "year_label"}


def period_stats(totals: DataFrame, grain: str) -> DataFrame:
    """Mean, min and max of in, out and flow plus observed weeks for one grain."""
    t = add_period_fields(totals).withColumn("year_label", F.col("year").cast("string"))
    return t.groupBy("wwtp", F.col(GRAINS[grain]).alias("period")).agg(
        *[c for s in _STATS for c in _spread(s)], _weeks()
    )


def all_period_stats(totals: DataFrame) -> DataFrame:
    """The four grains in one pass over the totals.

    (week, site) is unique in the totals, so plain counts replace the distinct week count and
    every grain is combined before the shuffle.
    """
    t = add_period_fields(totals).withColumn("year_label", F.col("year").cast("string"))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(g).alias("grain"), F.col(c).alias("period")) for g, c in GRAINS.items()])
    )
    return (
        t.select("wwtp", *_STATS, pairs.alias("p"))
        .groupBy("wwtp", F.col("p.grain").alias("grain"), F.col("p.period").alias("period"))
        .agg(*[c for s in _STATS for c in _spread(s)], F.count(F.lit(1)).alias("n_weeks"))
    )


def monthly_trip_stats(totals: DataFrame) -> DataFrame:
    t = add_period_fields(totals)
    return t.groupBy("wwtp", "year", "month").agg(
        *_spread("total_in"), *_spread("total_out"), _weeks()
    )


def monthly_mean(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column by (keys, year, month) of the Monday."""
    keys = keys or ["wwtp"]
    numeric = [
        f.name
        for f in weekly.schema.fields
        if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in keys
    ]
    t = weekly.withColumns({"year": F.year("week"), "month": F.month("week")})
    return t.groupBy(*keys, "year", "month").agg(*[F.avg(c).alias(c) for c in numeric])


def complete_grid(edges: DataFrame) -> DataFrame:
    """Observed weeks x counties ever seen, per (direction, site); gaps are zero volume.

    The site's weeks travel as one array (bounded by the calendar) and are exploded next to
    each county, so no side of a many-to-many join is built.
    """
    pair = ["direction", "wwtp"]
    edges = stage(edges)
    weeks = edges.groupBy(*pair).agg(F.collect_set("week").alias("_weeks"))
    counties = edges.select(*pair, "county_fips").distinct()
    grid = counties.join(weeks, pair).select(*pair, "county_fips", F.explode("_weeks").alias("week"))
    return (
        grid.join(edges, EDGE_KEY, "left")
        .select(*EDGE_KEY, F.coalesce("volume", F.lit(0.0)).alias("volume"), "area", "population")
    )


def _zero_filled(edges: DataFrame, grid: DataFrame, keys: list[str], weeks: Column) -> DataFrame:
    """Statistics of volume over ``weeks`` weeks of which only the positive rows exist."""
    seen = edges.groupBy(*keys).agg(
        F.sum("volume").alias("_s"),
        F.min("volume").alias("_lo"),
        F.max("volume").alias("_hi"),
        F.count("volume").alias("_n"),
    )
    gap = F.coalesce("_n", F.lit(0)) < weeks
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(0.0))
    return grid.join(seen, keys, "left").withColumns(
        {
            "volume_mean": F.coalesce("_s", F.lit(0.0)) / weeks,
            "volume_min": F.when(gap, F.least(lo, F.lit(0.0))).otherwise(lo),
            "volume_max": F.when(gap, F.greatest(hi, F.lit(0.0))).otherwise(hi),
        }
    ).drop("_s", "_lo", "_hi", "_n")


def _one_direction(edges: DataFrame, direction: str) -> DataFrame:
    """Collapsed volumes of one direction with their month, staged because several branches read them."""
    return stage(
        edges.filter(F.col("direction") == direction).groupBy("week", "wwtp", "county_fips").agg(F.sum("volume").alias("volume"))
        .withColumn("year_month", F.date_format("week", "yyyy-MM"))
    )


def county_monthly(edges: DataFrame, direction: str) -> DataFrame:
    """Mean, min, max and weeks per (site, county, month) on the completed grid.

    The grid is never built: zeros enter through the number of observed weeks.
    """
    e = _one_direction(edges, direction)
    site_month = e.groupBy("wwtp", "year_month").agg(F.count_distinct("week").alias("n_weeks"))
    months = site_month.groupBy("wwtp").agg(
        F.collect_list(F.struct("year_month", "n_weeks")).alias("_months")
    )
    grid = (
        e.select("wwtp", "county_fips").distinct().join(months, "wwtp")
        .select("wwtp", "county_fips", F.explode("_months").alias("_m"))
        .select("wwtp", "county_fips", "_m.year_month", "_m.n_weeks")
    )
    return _zero_filled(e, grid, ["wwtp", "county_fips", "year_month"], F.col("n_weeks"))


def combine_directions(inbound: DataFrame, outbound: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Full outer join of the two monthly tables with zero fill."""
    keys = ["wwtp", "county_fips", "year_month"]
    stats = ["volume_mean", "volume_min", "volume_max", "n_weeks"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = [F.col(s).alias(f"{tag}_{s}") for s in stats]
        name = F.col("county_name") if "county_name" in df.columns else F.lit(None).cast("string")
        return df.select(*keys, *cols, name.alias(f"_{tag}_name"))

    j = side(inbound, "in").join(side(outbound, "out"), keys, "full")
    filled = {f"{t}_{s}": F.coalesce(F.col(f"{t}_{s}"), F.lit(0.0)) for t in ("in", "out") for s in stats[:3]}
    filled |= {f"{t}_n_weeks": F.coalesce(F.col(f"{t}_n_weeks"), F.lit(0)).cast("int") for t in ("in", "out")}
    blank = [F.nullif(F.trim(f"_{t}_name"), F.lit("")) for t in ("in", "out")]
    return j.withColumns(filled).withColumn("county_name", F.coalesce(*blank)).drop("_in_name", "_out_name")


def county_sources_monthly(edges: DataFrame, direction: str) -> DataFrame:
    """As ``county_monthly`` with counties seen within the month; all-zero rows dropped."""
    e = _one_direction(edges, direction)
    site_month = e.groupBy("wwtp", "year_month").agg(F.count_distinct("week").alias("n_weeks"))
    grid = e.select("wwtp", "county_fips", "year_month").distinct().join(site_month, ["wwtp", "year_month"])
    out = _zero_filled(e, grid, ["wwtp", "county_fips", "year_month"], F.col("n_weeks"))
    return out.filter(F.col("volume_mean") != 0)


def yoy_monthly(
    weekly: DataFrame, value_cols: list[str], min_years: int = 2, months: list[int] | None = None
) -> DataFrame:
    """Monthly means per (site, year, month), kept for sites with enough years of data."""
    t = weekly.withColumns({"year": F.year("week"), "month": F.month("week")})
    if months:
        t = t.filter(F.col("month").isin(months))
    out = stage(t.groupBy("wwtp", "year", "month").agg(*[F.avg(c).alias(c) for c in value_cols], _weeks()))
    years = out.groupBy("wwtp").agg(F.count_distinct("year").alias("n_years"))
    return out.join(years.filter(F.col("n_years") >= min_years), "wwtp")


def match_target(values: DataFrame, col: str, name: str) -> DataFrame:
    """Exact match, else the only value that contains or is contained in ``name``."""
    v = F.lower(F.trim(F.col(col)))
    t = name.strip().lower()
    hits = values.select(F.col(col)).distinct().select(
        F.col(col), (v == t).alias("exact"), (v.contains(t) | F.lit(t).contains(v)).alias("near")
    )
    return (
        hits.agg(
            F.min(F.when(F.col("exact"), F.col(col))).alias("_exact"),
            F.min(F.when(F.col("near"), F.col(col))).alias("_near"),
            F.count_if("near").alias("_n"),
        )
        .select(F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_near"))).alias("matched"))
    )


def flow_per_capita(totals: DataFrame, sites: DataFrame) -> DataFrame:
    """(in + out) / population served per site-week."""
    pop = sites.select("wwtp", "pop_served")
    return totals.join(pop, "wwtp", "left").select(
        "week", "wwtp", "total_flow", "pop_served",
        ratio(F.col("total_flow"), F.col("pop_served")).alias("flow_per_capita"),
    )


def od_flow_stats(flows: DataFrame, n_nodes: DataFrame, by: str | None = "week") -> DataFrame:
    """Density, spread and entropy of the off-diagonal row-normalised flow matrix.

    ``flows``: (week, src, dst, w), ``n_nodes``: one row with ``n``.  With ``by=None`` the flows
    are summed over the window first.  Absent cells and empty rows count as zeros.
    """
    keys = [by] if by else []
    e = flows.filter((F.col("src") != F.col("dst")) & (F.col("w") > 0))
    e = e.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))
    p = e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "src")))  # at most n cells per row
    per_row = p.groupBy(*keys, "src").agg(
        F.sum(-F.col("p") * F.ln("p")).alias("h"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("p") * F.col("p")).alias("s2"),
        F.sum("p").alias("s1"),
    )
    ent = F.when(F.col("k") > 1, F.col("h") / F.ln(F.col("k").cast("double"))).otherwise(0.0)
    agg = per_row.groupBy(*keys).agg(
        F.sum("k").alias("nnz"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum(ent).alias("hsum")
    ).crossJoin(F.broadcast(n_nodes))
    cells = F.col("n") * F.col("n") - F.col("n")
    mean = F.col("s1") / cells
    return agg.select(
        *keys,
        (F.col("nnz") * 100.0 / cells).alias("density_pct"),
        F.sqrt(F.greatest(F.col("s2") / cells - mean * mean, F.lit(0.0))).alias("std_flow"),
        (F.col("hsum") / F.col("n")).alias("mean_entropy"),
        "nnz",
    )
