"""Baseline strategies: simple orders, greedy covers and geographic spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.functions.expr import row_mean
from netreach.functions.scaling import minmax
from netreach.operators.coverage import as_order
from netreach.operators.graph import METRICS
from netreach.operators.ranking import order_by_rank, rank_columns
from netreach.operators.spread import farthest_first
from netreach.plans.greedy import greedy_cover
from netreach.plans.ordering import number_rows, top_rows
from netreach.plans.staging import stage


def population_order(features: DataFrame, n: int) -> DataFrame:
    """n largest sites by population served."""
    v = F.round(F.coalesce("pop_served", F.lit(0.0)), 6)
    return top_rows(features.select("wwtp", "pop_served"), [v.desc(), F.col("wwtp")], n, "ord").select("ord", "wwtp")


def single_metric_order(features: DataFrame, metric: str, n: int) -> DataFrame:
    """area_only, mobility_only or score-only order."""
    v = F.round(F.coalesce(metric, F.lit(0.0)), 6)
    return top_rows(features.select("wwtp", metric), [v.desc(), F.col("wwtp")], n, "ord").select("ord", "wwtp")


def mean_rank_order(features: DataFrame, metrics: list[str], n: int) -> DataFrame:
    r = rank_columns(features, metrics).withColumn("v", row_mean([F.col(f"rank_{m}") for m in metrics]))
    return top_rows(r, [F.col("v").asc_nulls_last(), F.col("wwtp")], n, "ord").select("ord", "wwtp")


def _with_rest(features: DataFrame, picks: DataFrame, fill: str, n: int | None, linked: DataFrame | None = None) -> DataFrame:
    """(ord, wwtp, gain): greedy picks (wwtp, gain, ord), sites of ``linked`` (wwtp, tie) that add nothing, then all others by a metric.

    ``n=None`` orders every site.
    """
    v = F.round(F.coalesce(fill, F.lit(0.0)), 6)
    rest = features.select("wwtp", F.lit(2).alias("_tier"), (-v).alias("_k"), F.lit(0.0).alias("gain"))
    if linked is not None:
        rest = rest.join(linked.select("wwtp"), "wwtp", "left_anti").unionByName(
            linked.select("wwtp", F.lit(1).alias("_tier"), F.col("tie").alias("_k"), F.lit(0.0).alias("gain")))
    rows = rest.join(picks.select("wwtp"), "wwtp", "left_anti").unionByName(
        picks.select("wwtp", F.lit(0).alias("_tier"), F.col("ord").cast("double").alias("_k"), "gain"))
    order = [F.col("_tier"), F.col("_k"), F.col("wwtp")]
    numbered = number_rows(rows, [], order, "ord") if n is None else top_rows(rows, order, n, "ord")
    return numbered.select(F.col("ord").cast("long").alias("ord"), "wwtp", "gain")


def greedy_new_area(links: DataFrame, features: DataFrame, n: int, direction: str = "Destination",
                    full: bool = False) -> DataFrame:
    """Each step the site with most new fine-area surface; filled by area reached.

    Ties: area + .01 population + .0001 volume, each scaled over all sites, then name.
    """
    per = stage(
        links.filter(F.lower("direction") == direction.lower())
        .groupBy("bg_fips", "wwtp").agg(F.max("area").alias("area"))
    )
    mass = per.groupBy("bg_fips").agg(F.max("area").alias("mass"))
    pairs = per.join(mass, "bg_fips").select("wwtp", F.col("bg_fips").alias("item"), "mass")
    tie = minmax(features.fillna(0.0, METRICS), {"area_reached": "_a", "pop_covered_by_od": "_p", "od_volume_total": "_v"})
    tie = stage(tie.select("wwtp", (-F.round(F.col("_a") + 0.01 * F.col("_p") + 0.0001 * F.col("_v"), 9)).alias("tie")))
    picks = stage(greedy_cover(pairs, tie, limit=None if full else n))
    linked = pairs.select("wwtp").distinct().join(tie, "wwtp")
    return _with_rest(features, picks, "area_reached", None if full else n, linked)


def greedy_new_polygon_area(
    cells: DataFrame, features: DataFrame, cell_area: float, n: int, full: bool = False, members: DataFrame | None = None,
) -> DataFrame:
    """Greedy on the sites' own polygon cells; ties and fill by population.

    With ``members`` (wwtp, shape) the cells are those of shapes.  Sites of one shape always add the same, so the first of
    them in the order of ties competes for all, and after it the others add nothing.
    """
    tie = stage(features.select("wwtp", (-F.round(F.coalesce("pop_served", F.lit(0.0)), 9)).alias("tie")))
    if members is not None:
        first = members.join(tie, "wwtp").groupBy("shape").agg(F.min(F.struct("tie", "wwtp")).alias("f")).select("shape", "f.wwtp")
        cells = cells.withColumnRenamed("wwtp", "shape").join(first.hint("merge"), "shape")
    pairs = cells.select("wwtp", F.concat_ws(":", "cx", "cy").alias("item"), F.lit(float(cell_area)).alias("mass"))
    return _with_rest(features, stage(greedy_cover(pairs, tie, limit=None if full else n)), "pop_served", None if full else n)


def cbsa_order(features: DataFrame, sites: DataFrame, assigned: DataFrame, n: int | None) -> DataFrame:
    """One representative per census area, then geographic spread outside, then anywhere; ``n=None`` orders every site.

    ``assigned``: (wwtp, cbsa, lsad) with null cbsa outside.
    """
    base = minmax(features.select("wwtp", F.coalesce("pop_served", F.lit(0.0)).alias("pop")), {"pop": "score"})
    d = base.join(sites.select("wwtp", "x", "y"), "wwtp", "left").join(assigned.select("wwtp", "cbsa", "lsad"), "wwtp", "left")
    d = stage(d.withColumn("score", F.round("score", 9)))
    group = d.filter(F.col("cbsa").isNotNull()).groupBy("cbsa").agg(
        F.round(F.sum("score"), 6).alias("total"), F.min(F.struct((-F.col("score")).alias("s"), "wwtp", "x", "y", "lsad")).alias("rep")
    )
    kind = F.when(F.col("rep.lsad") == "M1", 0).when(F.col("rep.lsad") == "M2", 1).otherwise(2)
    order = [kind, -F.col("total"), F.col("rep.s"), F.col("rep.wwtp")]
    reps = number_rows(group, [], order, "ord") if n is None else top_rows(group, order, n, "ord")
    done = stage(reps.select(F.col("ord").cast("long").alias("ord"), "rep.wwtp", F.lit("cbsa_representative").alias("source"), "rep.x", "rep.y"))
    for where, label in ((F.col("cbsa").isNull(), "farthest_outside_cbsa"), (F.lit(True), "farthest_remaining")):
        count = done.count()
        room = None if n is None else n - count
        if room == 0:
            break
        left = d.filter(where).join(done.select("wwtp"), "wwtp", "left_anti").select("wwtp", "x", "y", "score")
        more = farthest_first(left, done.select("x", "y"), room)
        done = stage(done.unionByName(more.select((F.col("ord") + count).alias("ord"), "wwtp", F.lit(label).alias("source"), "x", "y")))
    return done.select("ord", "wwtp", "source")


def full_level1_order(ranks: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected sites in their order, all others by mean of the four ranks."""
    cols = [f"rank_{m}" for m in METRICS]
    r = ranks.join(selected.select("wwtp", F.col("ord").alias("_s")), "wwtp", "left").withColumn(
        "v", F.round(row_mean([F.col(c) for c in cols]), 6))
    first = F.coalesce(F.col("_s").cast("double"), F.lit(float("inf")))
    return number_rows(r, [], [first, F.coalesce("v", F.lit(float("inf"))), F.col("wwtp")], "ord").select("ord", "wwtp")


def full_orders(orders: dict[str, DataFrame]) -> DataFrame:
    """(strategy, ord, wwtp) of several complete orders."""
    out = None
    for name, df in orders.items():
        part = df.select(F.lit(name).alias("strategy"), F.col("ord").cast("long").alias("ord"), "wwtp")
        out = part if out is None else out.unionByName(part)
    return out


def metric_order(features: DataFrame, metric: str, strategy: str) -> DataFrame:
    return as_order(features, strategy, metric)


def rank_order(ranks: DataFrame) -> DataFrame:
    return order_by_rank(ranks).select("ord", "wwtp")
