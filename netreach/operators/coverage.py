"""Cumulative and overlap-free coverage curves, closed form over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import ratio
from netreach.operators.graph import METRICS
from netreach.plans.ordering import number_rows, running_sums
from netreach.plans.staging import stage


def cumulative(features: DataFrame, order: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Delta, running sum and share of the total per metric, along (strategy, ord)."""
    metrics = metrics or METRICS
    d = stage(order.select("strategy", "ord", "wwtp").join(features.select("wwtp", *metrics), "wwtp", "left").fillna(0.0, metrics))
    total = d.groupBy("strategy").agg(*[F.sum(m).alias(f"_t_{m}") for m in metrics])
    run = running_sums(d, ["strategy"], [F.col("ord"), F.col("wwtp")], {f"cum_{m}": F.col(m) for m in metrics}, staged=True)
    out = run.join(total, "strategy")
    return out.select(
        "strategy", "ord", "wwtp",
        *[F.col(m).alias(f"delta_{m}") for m in metrics], *[F.col(f"cum_{m}") for m in metrics],
        *[ratio(F.col(f"cum_{m}"), F.col(f"_t_{m}")).alias(f"frac_{m}") for m in metrics],
    )


def link_weights(
    links: DataFrame, direction: str = "Destination", mode: str = "intensity_exp", weight: str = "volume",
    tau: float = 2.0, eps: float = 100.0, union_mode: str = "cap_sum", min_weight: float = 0.0,
    by: list[str] | None = None,
) -> DataFrame:
    """Coverage weight per (site, fine area) with the area's population and size.

    Weeks are summed with map-side combine before anything is shuffled by fine area.
    """
    by = by or []
    m = (
        links.filter(F.lower("direction") == direction.lower())
        .groupBy(*by, "bg_fips", "wwtp")
        .agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("s"), F.max("population").alias("population"), F.max("area").alias("area"))
        .filter(F.col("s") > min_weight)
    )
    bg = Window.partitionBy(*by, "bg_fips")
    m = m.withColumns({
        "population": F.coalesce(F.max("population").over(bg), F.lit(0.0)),
        "area": F.coalesce(F.max("area").over(bg), F.lit(0.0)),
        "_site_sum": F.sum("s").over(bg),
    })
    per_head = F.try_divide(F.col("s"), F.lit(tau) * (F.col("population") + F.lit(eps)))
    w = {
        "share": F.try_divide(F.col("s"), F.col("_site_sum")),
        "intensity_cap": F.least(F.lit(1.0), per_head),
        "intensity_exp": 1 - F.exp(-per_head),
    }[mode]
    if union_mode == "binary":
        w = F.lit(1.0)
    return m.select(*by, "bg_fips", "wwtp", F.coalesce(w, F.lit(0.0)).alias("w"), "population", "area")


def covered_steps(order: DataFrame, weights: DataFrame, union_mode: str = "cap_sum") -> DataFrame:
    """Gain in coverage of every fine area at every step of every strategy.

    One window per (strategy, fine area); a fine area meets each site once, so a window holds
    at most one row per site.
    """
    j = weights.join(order.select("strategy", "ord", "wwtp"), "wwtp")
    step = Window.partitionBy("strategy", "bg_fips").orderBy("ord", "wwtp")
    upto, before = step.rowsBetween(Window.unboundedPreceding, 0), step.rowsBetween(Window.unboundedPreceding, -1)

    def cap(w):
        return F.least(F.lit(1.0), F.coalesce(F.sum("w").over(w), F.lit(0.0)))

    def union(w):
        full = F.coalesce(F.max(F.col("w") >= 1).over(w), F.lit(False))
        left = F.exp(F.coalesce(F.sum(F.when(F.col("w") < 1, F.ln(1 - F.col("w")))).over(w), F.lit(0.0)))
        return F.when(full, 1.0).otherwise(1 - left)

    if union_mode == "binary":
        gain = F.when(F.row_number().over(step) == 1, 1.0).otherwise(0.0)
    elif union_mode == "cap_sum":
        gain = cap(upto) - cap(before)
    elif union_mode == "prob_union":
        gain = union(upto) - union(before)
    else:
        raise ValueError(f"unknown union mode {union_mode}")
    return j.withColumn("gain", gain)


def union_coverage(
    order: DataFrame, weights: DataFrame, union_mode: str = "cap_sum", steps: DataFrame | None = None
) -> DataFrame:
    """New population and area each site adds, and their running sums, per strategy."""
    g = covered_steps(order, weights, union_mode) if steps is None else steps
    deltas = g.groupBy("strategy", "ord", "wwtp").agg(
        F.sum(F.col("population") * F.col("gain")).alias("delta_population"),
        F.sum(F.col("area") * F.col("gain")).alias("delta_area"),
    )
    d = order.select("strategy", "ord", "wwtp").join(deltas, ["strategy", "ord", "wwtp"], "left")
    d = d.fillna(0.0, ["delta_population", "delta_area"])
    return running_sums(
        d, ["strategy"], [F.col("ord"), F.col("wwtp")],
        {"cum_population": F.col("delta_population"), "cum_area": F.col("delta_area")},
    )


def linked_mass(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Population and area of all linked fine areas (each counted once)."""
    by = by or []
    bg = weights.groupBy(*by, "bg_fips").agg(F.max("population").alias("p"), F.max("area").alias("a"))
    return bg.groupBy(*by).agg(F.sum("p").alias("linked_population"), F.sum("a").alias("linked_area"))


def coverage_table(
    order: DataFrame, links: DataFrame, features: DataFrame, union_mode: str = "cap_sum", mode: str = "intensity_exp",
    direction: str = "Destination", tau: float = 2.0, eps: float = 100.0, pop_total: float | None = None,
    weights: DataFrame | None = None, steps: DataFrame | None = None,
) -> DataFrame:
    """Union coverage beside additive population and volume, with fractions of the totals.

    Reach fractions refer to linked fine areas; volume refers to all sites.  Staged ``weights``
    and ``steps`` of the same links and order may be handed in.
    """
    if weights is None:
        weights = stage(link_weights(links, direction, mode, tau=tau, eps=eps, union_mode=union_mode))
    curve = union_coverage(order, weights, union_mode, steps)
    add = cumulative(features, order, ["pop_served", "od_volume_total"])
    served = order.join(features.select("wwtp", "pop_served"), "wwtp", "left").groupBy("strategy").agg(
        F.coalesce(F.sum("pop_served"), F.lit(0.0)).alias("_served")
    )
    vol = features.agg(F.sum("od_volume_total").alias("_vol"))
    out = curve.join(add, ["strategy", "ord", "wwtp"]).join(served, "strategy")
    out = out.crossJoin(F.broadcast(linked_mass(weights))).crossJoin(F.broadcast(vol))
    denom = F.lit(float(pop_total)) if pop_total else F.col("_served")
    return out.select(
        "strategy", "ord", "wwtp", "delta_population", "cum_population", "delta_area", "cum_area",
        ratio(F.col("cum_population"), F.col("linked_population")).alias("frac_population"),
        ratio(F.col("cum_area"), F.col("linked_area")).alias("frac_area"),
        "cum_pop_served", ratio(F.col("cum_pop_served"), denom).alias("frac_pop_served"),
        "cum_od_volume_total", ratio(F.col("cum_od_volume_total"), F.col("_vol")).alias("frac_volume"),
        "linked_population", "linked_area",
        F.lit(mode).alias("weight_mode"), F.lit(union_mode).alias("union_mode"),
        F.lit(float(tau)).alias("tau"), F.lit(float(eps)).alias("eps"),
    )


def coverage_at_k(table: DataFrame, ks: list[int]) -> DataFrame:
    """Curve rows at the given positions; ``ord`` runs from 1."""
    return table.filter(F.col("ord").isin(ks))


def selected_summary(selected: DataFrame, features: DataFrame) -> DataFrame:
    """One row: sites given, unique, matched and missing, and each metric's share of all."""
    uniq = selected.select("wwtp").distinct()
    all_totals = features.agg(*[F.sum(m).alias(f"all_{m}") for m in METRICS])
    got = uniq.join(features.select("wwtp", *METRICS, F.lit(1).alias("_m")), "wwtp", "left").agg(
        F.count(F.lit(1)).alias("n_unique"), F.count("_m").alias("n_matched"),
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"sel_{m}") for m in METRICS],
    )
    n = selected.agg(F.count(F.lit(1)).alias("n_input"))
    out = n.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(all_totals))
    return out.select(
        "n_input", "n_unique", "n_matched", (F.col("n_unique") - F.col("n_matched")).alias("n_missing"),
        *[F.col(f"sel_{m}") for m in METRICS],
        *[ratio(F.col(f"sel_{m}"), F.col(f"all_{m}")).alias(f"frac_{m}") for m in METRICS],
    )


def coverage_for_orders(orders: DataFrame, links: DataFrame, features: DataFrame, **kw) -> DataFrame:
    """Curves of many strategies in one job: the strategy is part of every key."""
    return coverage_table(orders, links, features, **kw)


def as_order(df: DataFrame, strategy: str, value: str, descending: bool = True) -> DataFrame:
    """(strategy, ord, wwtp) from a numeric column, site name last."""
    v = F.round(F.coalesce(F.col(value), F.lit(0.0)), 6)
    o = number_rows(df.select("wwtp", value), [], [-v if descending else v, F.col("wwtp")], "ord")
    return o.select(F.lit(strategy).alias("strategy"), "ord", "wwtp")


