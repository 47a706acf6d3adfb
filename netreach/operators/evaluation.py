"""One common evaluation of site orders; the strategy is a key in every aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import pearson, ratio, row_mean, row_min
from netreach.functions.keys import area_county
from netreach.functions.scaling import minmax
from netreach.operators.coverage import coverage_table, covered_steps, cumulative, link_weights
from netreach.operators.graph import nearest_other
from netreach.plans.ordering import competition_rank, exact_quantiles, top_rows
from netreach.plans.staging import stage


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select("strategy", "ord", "wwtp").dropDuplicates(["strategy", "wwtp"])


def overlap(orders: DataFrame, primary: str) -> DataFrame:
    """Overlap of every order with the primary one: counts, fractions, Jaccard, site lists."""
    o = _orders(orders)
    base = o.filter(F.col("strategy") == primary).select("wwtp", F.lit(True).alias("_in"))
    j = o.join(base, "wwtp", "left")
    lists = {
        "overlap_sites": F.when(F.col("_in"), F.col("wwtp")),
        "only_sites": F.when(F.col("_in").isNull(), F.col("wwtp")),
    }
    g = j.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count("_in").alias("n_overlap"),
        *[F.array_join(F.sort_array(F.collect_list(c)), ";").alias(k) for k, c in lists.items()],
    ).crossJoin(F.broadcast(base.agg(F.count(F.lit(1)).alias("n_primary"))))
    return g.select(
        "strategy", "n_sites", "n_primary", "n_overlap",
        ratio(F.col("n_overlap"), F.col("n_sites")).alias("frac_of_strategy"),
        ratio(F.col("n_overlap"), F.col("n_primary")).alias("frac_of_primary"),
        ratio(F.col("n_overlap"), F.col("n_sites") + F.col("n_primary") - F.col("n_overlap")).alias("jaccard"),
        "overlap_sites", "only_sites",
    )


def membership(orders: DataFrame, strategies: list[str]) -> DataFrame:
    """Per site: in which orders it appears."""
    o = _orders(orders)
    flags = [F.max(F.col("strategy") == s).alias(f"in_{s}") for s in strategies]
    return o.groupBy("wwtp").agg(*flags, F.count_distinct("strategy").alias("n_strategies"))


def spatial_stats(
    orders: DataFrame, sites: DataFrame, comps: DataFrame, counties: DataFrame, cbsa: DataFrame, small: int = 2
) -> DataFrame:
    """Counties, components, spacing and census areas represented by each order.

    ``counties``: (wwtp, county_fips) linked counties of a site.
    """
    o = stage(_orders(orders))
    n_counties = o.join(counties, "wwtp").groupBy("strategy").agg(F.count_distinct("county_fips").alias("n_counties"))
    total = comps.agg(F.count_distinct("component").alias("n_components_all"))
    size = F.col("component_size")
    comp = o.join(comps, "wwtp", "left").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_distinct("component").alias("n_components"),
        F.count_if(size == 1).alias("n_singleton_sites"), F.count_if(size <= small).alias("n_small_component_sites"),
        F.count_if(size > small).alias("n_large_component_sites"),
    )
    near = nearest_other(o.join(sites.select("wwtp", "x", "y"), "wwtp"), ["strategy"])
    near = near.groupBy("strategy").agg(F.avg(F.when(F.col("nearest_km") != float("inf"), F.col("nearest_km"))).alias("mean_nn_km"))
    c = o.join(cbsa.select("wwtp", "cbsa", "cbsa_type", "in_cbsa"), "wwtp", "left")
    inside = F.coalesce("in_cbsa", F.lit(False))
    areas = c.groupBy("strategy").agg(
        F.count_distinct("cbsa").alias("n_cbsa"),
        F.count_distinct(F.when(F.col("cbsa_type") == "Metro", F.col("cbsa"))).alias("n_metro_cbsa"),
        F.count_distinct(F.when(F.col("cbsa_type") == "Micro", F.col("cbsa"))).alias("n_micro_cbsa"),
        F.count_if(~inside).alias("n_outside_cbsa_sites"),
        F.avg(inside.cast("double")).alias("cbsa_site_frac"),
        F.avg((F.coalesce("cbsa_type", F.lit("")) == "Metro").cast("double")).alias("metro_site_frac"),
    )
    out = comp.crossJoin(F.broadcast(total)).join(n_counties, "strategy", "left").join(near, "strategy", "left").join(areas, "strategy")
    return out.withColumn("component_representation_frac", ratio(F.col("n_components"), F.col("n_components_all")))


def score_stats(orders: DataFrame, scores: DataFrame, features: DataFrame) -> DataFrame:
    """Mean, median, population-weighted mean, score x population share, top-quarter capture."""
    f = stage(features.select("wwtp", F.coalesce("pop_served", F.lit(0.0)).alias("pop"))
              .join(scores.select("wwtp", "score"), "wwtp", "left"))
    q = exact_quantiles(f, [], "score", {"q75": 0.75})
    f = stage(f.crossJoin(F.broadcast(q)).withColumn("high", F.coalesce(F.col("score") >= F.col("q75"), F.lit(False))))
    sp = F.coalesce("score", F.lit(0.0)) * F.col("pop")
    allv = f.agg(F.sum(sp).alias("_all_sp"), F.count_if("high").alias("_all_high"),
                 F.sum(F.when(F.col("high"), F.col("pop"))).alias("_all_high_pop"))
    j = stage(_orders(orders).join(f, "wwtp"))
    med = exact_quantiles(j, ["strategy"], "score", {"score_median": 0.5})
    g = j.groupBy("strategy").agg(
        F.avg("score").alias("score_mean"),
        ratio(F.sum(sp), F.sum(F.when(F.col("score").isNotNull(), F.col("pop")))).alias("score_pop_weighted_mean"),
        F.sum(sp).alias("_sp"), F.count_if("high").alias("n_high_sites"),
        F.sum(F.when(F.col("high"), F.col("pop"))).alias("_hp"),
    ).crossJoin(F.broadcast(allv)).join(med, "strategy", "left")
    return g.select(
        "strategy", "score_mean", "score_median", "score_pop_weighted_mean",
        ratio(F.col("_sp"), F.col("_all_sp")).alias("score_pop_frac"), "n_high_sites",
        ratio(F.col("n_high_sites"), F.col("_all_high")).alias("high_sites_frac"),
        ratio(F.coalesce("_hp", F.lit(0.0)), F.col("_all_high_pop")).alias("high_pop_frac"),
    )


def _county_mass(weights: DataFrame) -> DataFrame:
    bg = weights.groupBy("bg_fips").agg(F.max("area").alias("area"), F.max("population").alias("population"))
    return bg.withColumn("county_fips", area_county("bg_fips"))


def county_fractions(steps: DataFrame, weights: DataFrame, strategies: DataFrame) -> DataFrame:
    """Covered share of each county's linked area per strategy, zeros included.

    Each bg has one county, so the gains can be summed by county without a pass per bg.
    """
    county = _county_mass(weights).groupBy("county_fips").agg(F.sum("area").alias("_total")).filter(F.col("_total") > 0)
    got = steps.groupBy("strategy", area_county("bg_fips").alias("county_fips")).agg(F.sum(F.col("area") * F.col("gain")).alias("_got"))
    grid = county.crossJoin(F.broadcast(strategies.agg(F.collect_set("strategy").alias("_s"))))
    grid = grid.select("county_fips", "_total", F.explode("_s").alias("strategy"))
    frac = F.coalesce(F.col("_got"), F.lit(0.0)) / F.col("_total")
    return grid.join(got, ["strategy", "county_fips"], "left").select(
        "strategy", "county_fips", F.least(F.lit(1.0), F.greatest(F.lit(0.0), frac)).alias("frac"))


def county_contribution(
    orders: DataFrame, weights: DataFrame, union_mode: str = "cap_sum", threshold: float = 0.05, steps: DataFrame | None = None
) -> DataFrame:
    """County reach and the evenness of the sites' own contributions."""
    o = _orders(orders)
    steps = stage(covered_steps(o, weights, union_mode)) if steps is None else steps
    fr = stage(county_fractions(steps, weights, o))
    med = exact_quantiles(fr, ["strategy"], "frac", {"county_coverage_median": 0.5})
    c = fr.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_counties_total"), F.count_if(F.col("frac") > 0).alias("n_counties_reached"),
        F.count_if(F.round("frac", 9) >= threshold).alias("n_counties_contributing"),
        F.avg("frac").alias("county_coverage_mean"), F.min("frac").alias("county_coverage_min"),
    ).join(med, "strategy", "left")
    d = steps.groupBy("strategy", "wwtp").agg(
        F.sum(F.col("area") * F.col("gain")).alias("a"), F.sum(F.col("population") * F.col("gain")).alias("p")
    )
    top3 = d.withColumn("_r", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("a"), "wwtp"))).filter("_r <= 3")
    top3 = top3.groupBy("strategy").agg(F.max("a").alias("_t1"), F.sum("a").alias("_t3"))
    n = o.groupBy("strategy").agg(F.count(F.lit(1)).alias("_n"))

    def even(c: str) -> Column:
        pos = F.when(F.col(c) > 0, F.col(c))
        return ratio(F.sum(pos) * F.sum(pos), F.sum(pos * pos))

    e = d.groupBy("strategy").agg(even("a").alias("_ea"), even("p").alias("_ep"), F.sum("a").alias("_sum"))
    out = c.join(n, "strategy").join(e, "strategy", "left").join(top3, "strategy", "left")
    return out.select(
        "strategy", "n_counties_total", "n_counties_reached",
        ratio(F.col("n_counties_reached"), F.col("n_counties_total")).alias("counties_reached_frac"),
        "n_counties_contributing",
        ratio(F.col("n_counties_contributing"), F.col("n_counties_total")).alias("counties_contributing_frac"),
        "county_coverage_mean", "county_coverage_median", "county_coverage_min",
        (F.col("_ea") / F.col("_n")).alias("site_area_evenness"), (F.col("_ep") / F.col("_n")).alias("site_pop_evenness"),
        ratio(F.col("_t1"), F.col("_sum")).alias("top1_frac"), ratio(F.col("_t3"), F.col("_sum")).alias("top3_frac"),
    )


def county_balanced(orders: DataFrame, weights: DataFrame, union_mode: str = "cap_sum", top: int = 8) -> DataFrame:
    """Coverage share / number of counties per county; the largest counties, the rest as "Other"."""
    o = _orders(orders)
    fr = county_fractions(covered_steps(o, weights, union_mode), weights, o)
    n = _county_mass(weights).filter(F.col("area") > 0).agg(F.count_distinct("county_fips").alias("n"))
    fr = stage(fr.crossJoin(F.broadcast(n)).withColumn("part", F.col("frac") / F.col("n")))
    big = fr.groupBy("county_fips").agg(F.round(F.sum("part"), 9).alias("s"))
    big = top_rows(big, [F.desc("s"), F.col("county_fips")], top).select("county_fips", F.col("county_fips").alias("_name"))
    return (
        fr.join(F.broadcast(big), "county_fips", "left")  # ``top`` rows
        .groupBy("strategy", F.coalesce("_name", F.lit("Other counties")).alias("county"))
        .agg(F.sum("part").alias("contribution"))
    )


def nonmetro_reach(
    orders: DataFrame, weights: DataFrame, metro: DataFrame, union_mode: str = "cap_sum", steps: DataFrame | None = None
) -> DataFrame:
    """Area, population and count fractions of fine areas outside metro counties."""
    o = _orders(orders)
    steps = covered_steps(o, weights, union_mode) if steps is None else steps
    outside = _county_mass(weights).join(metro.select("county_fips"), "county_fips", "left_anti")
    cov = steps.groupBy("strategy", "bg_fips").agg(F.least(F.lit(1.0), F.sum("gain")).alias("c"))
    got = cov.join(outside, "bg_fips").groupBy("strategy").agg(
        F.sum(F.col("area") * F.col("c")).alias("_a"), F.sum(F.col("population") * F.col("c")).alias("_p"),
        F.count_if(F.col("c") > 0).alias("n_nonmetro_reached"),
    )
    total = outside.agg(F.sum("area").alias("_at"), F.sum("population").alias("_pt"), F.count(F.lit(1)).alias("n_nonmetro_total"))
    known = metro.agg(F.count(F.lit(1)).alias("_m"))
    j = o.select("strategy").distinct().join(got, "strategy", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(known))

    def known_only(c: Column) -> Column:
        return F.when(F.col("_m") > 0, c)

    z = F.lit(0.0)
    return j.select(
        "strategy",
        known_only(ratio(F.coalesce("_a", z), F.col("_at"))).alias("nonmetro_area_frac"),
        known_only(ratio(F.coalesce("_p", z), F.col("_pt"))).alias("nonmetro_pop_frac"),
        known_only(ratio(F.coalesce("n_nonmetro_reached", F.lit(0)), F.col("n_nonmetro_total"))).alias("nonmetro_bg_frac"),
        known_only(F.col("n_nonmetro_total")).alias("n_nonmetro_total"),
        known_only(F.coalesce("n_nonmetro_reached", F.lit(0))).alias("n_nonmetro_reached"),
    )


def risk_capture(orders: DataFrame, risk: DataFrame, features: DataFrame) -> DataFrame:
    """Risk of the chosen sites, its share of all, and the high-risk sites among them."""
    r = stage(features.select("wwtp").join(risk.select("wwtp", "risk"), "wwtp", "left")
              .select("wwtp", F.greatest(F.coalesce("risk", F.lit(0.0)), F.lit(0.0)).alias("risk")))
    q = exact_quantiles(r, [], "risk", {"q75": 0.75})
    r = r.crossJoin(F.broadcast(q)).withColumn("high", F.col("risk") >= F.col("q75"))
    total = r.agg(F.sum("risk").alias("_t"), F.count_if("high").alias("_h"))
    g = _orders(orders).join(r, "wwtp").groupBy("strategy").agg(F.sum("risk").alias("risk_cum"), F.count_if("high").alias("n_high_risk"))
    return g.crossJoin(F.broadcast(total)).select(
        "strategy", "risk_cum", ratio(F.col("risk_cum"), F.col("_t")).alias("risk_frac"), "n_high_risk",
        ratio(F.col("n_high_risk"), F.col("_h")).alias("high_risk_frac"),
    )


CORE = ["frac_pop_served", "frac_population", "frac_area", "frac_volume"]
DESIGN = ["frac_area", "frac_volume", "counties_contributing_frac", "site_area_evenness", "component_representation_frac"]


def balance_scores(summary: DataFrame) -> DataFrame:
    """Mean and minimum of the core fractions and of the design metrics that carry any value."""
    core = [F.col(c) for c in CORE if c in summary.columns]
    design = [c for c in DESIGN if c in summary.columns]
    some = summary.agg(*[F.count(c).alias(f"_n_{c}") for c in design])
    d = summary.crossJoin(F.broadcast(some))
    cols = [F.col(c) for c in design]
    return d.withColumns({
        "balance_core_mean": row_mean(core), "balance_core_min": row_min(core),
        "design_mean": row_mean(cols), "design_min": row_min(cols),
        "design_metric_count": sum([(F.col(f"_n_{c}") > 0).cast("int") for c in design], F.lit(0)),
    }).withColumn("minimum_benefit_score", F.coalesce("design_min", "balance_core_min")).drop(*[f"_n_{c}" for c in design])


def evaluate(
    orders: DataFrame, links: DataFrame | None, features: DataFrame, sites: DataFrame, comps: DataFrame, counties: DataFrame,
    cbsa: DataFrame, metro: DataFrame, scores: DataFrame, risk: DataFrame, union_mode: str = "cap_sum",
) -> DataFrame:
    """One row per strategy: final coverage and every diagnostic.

    Without links the coverage falls back to additive sums.  Each diagnostic, a row per strategy, is staged by itself: the
    plan of all of them at once would be kept, planned again and told to listeners after every one of its shuffles.
    """
    o = stage(_orders(orders))
    last = o.groupBy("strategy").agg(F.max("ord").alias("ord"))
    if links is not None:
        weights = stage(link_weights(links, union_mode=union_mode))
        steps = stage(covered_steps(o, weights, union_mode))
        final = stage(coverage_table(o, links, features, union_mode, weights=weights, steps=steps).join(last, ["strategy", "ord"]))
        keep = ["cum_population", "cum_area", "cum_pop_served", "cum_od_volume_total", *CORE]
        out = final.select("strategy", *keep)
        parts = [county_contribution(o, weights, union_mode, steps=steps), nonmetro_reach(o, weights, metro, union_mode, steps)]
    else:
        final = stage(cumulative(features, o).join(last, ["strategy", "ord"]))
        parts = []
        out = final.select(
            "strategy", F.col("cum_pop_covered_by_od").alias("cum_population"), F.col("cum_area_reached").alias("cum_area"),
            "cum_pop_served", "cum_od_volume_total", "frac_pop_served", F.col("frac_pop_covered_by_od").alias("frac_population"),
            F.col("frac_area_reached").alias("frac_area"), F.col("frac_od_volume_total").alias("frac_volume"),
        )
    parts += [spatial_stats(o, sites, comps, counties, cbsa), score_stats(o, scores, features), risk_capture(o, risk, features)]
    for part in parts:
        out = out.join(stage(part), "strategy", "left")
    return balance_scores(stage(out))


def spearman(df: DataFrame, a: str, b: str, parts: list[str] | None = None, key: str = "wwtp") -> DataFrame:
    """Pearson correlation of average ranks over rows with both values."""
    parts = parts or []
    d = stage(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*parts, key, a, b))
    ra = competition_rank(d, parts, a, "_ra", average=True)
    both = stage(competition_rank(ra, parts, b, "_rb", average=True))
    return rank_correlation(both, "_ra", "_rb", parts)


def rank_correlation(df: DataFrame, a: str, b: str, parts: list[str]) -> DataFrame:
    x, y = F.col(a), F.col(b)
    g = df.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    r = pearson(F.col("n").cast("double"), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return g.select(*parts, "n", r.alias("spearman"))


def score_vs_rank(
    scores: DataFrame, level1: DataFrame, features: DataFrame, k: int = 20
) -> DataFrame:
    """Score ranks per pathogen beside population and Level-1 positions.

    ``scores``: (pathogen, wwtp, score); ``level1``: (wwtp, ord).  One row per (pathogen, site)
    with membership flags and the population percentile.
    """
    s = stage(scores.filter(F.col("score").isNotNull()).select("pathogen", "wwtp", F.round("score", 6).alias("score")))
    neg = competition_rank(s, ["pathogen"], "score", "score_rank", ascending=False)
    pop = stage(features.select("wwtp", F.coalesce("pop_served", F.lit(0.0)).alias("pop")))
    n = pop.agg(F.count(F.lit(1)).alias("_n"))
    up = competition_rank(pop, [], "pop", "_up", average=True)
    both = competition_rank(stage(up), [], "pop", "pop_rank", ascending=False)
    base = both.crossJoin(F.broadcast(n)).select("wwtp", "pop", "pop_rank", (F.col("_up") / F.col("_n") * 100).alias("pop_percentile"))
    j = neg.join(base, "wwtp", "left").join(level1.select("wwtp", F.col("ord").alias("level1_rank")), "wwtp", "left")
    return membership_group(j.withColumns({
        "in_score_top": F.col("score_rank") <= k,
        "in_level1_top": F.coalesce(F.col("level1_rank") <= k, F.lit(False)),
        "in_pop_top": F.coalesce(F.col("pop_rank") <= k, F.lit(False)),
    }))


def membership_group(df: DataFrame) -> DataFrame:
    """Both / L1 only / Pop only / Neither, with missed and captured flags."""
    s, a, b = F.col("in_score_top"), F.col("in_level1_top"), F.col("in_pop_top")
    group = F.when(a & b, "Both").when(a, "L1 only").when(b, "Pop only").otherwise("Neither")
    return df.withColumns({
        "group": group,
        "captured_by_both": s & a & b,
        "captured_by_level1_only": s & a & ~b,
        "captured_by_pop_only": s & b & ~a,
        "missed_by_level1": s & ~a,
        "missed_by_pop": s & ~b,
    })


def score_vs_rank_summary(rows: DataFrame) -> DataFrame:
    """Per pathogen: Spearman of score with population and Level-1 rank, overlap and missed counts."""
    r = stage(rows)
    a = spearman(r.withColumn("_l", -F.col("level1_rank")), "score", "_l", ["pathogen"]).select(
        "pathogen", F.col("spearman").alias("spearman_level1"))
    b = spearman(r, "score", "pop", ["pathogen"]).select("pathogen", F.col("spearman").alias("spearman_pop"))
    g = r.groupBy("pathogen").agg(
        F.count_if(F.col("in_score_top") & F.col("in_level1_top")).alias("overlap_level1"),
        F.count_if(F.col("in_score_top") & F.col("in_pop_top")).alias("overlap_pop"),
        F.count_if("missed_by_level1").alias("missed_level1"), F.count_if("missed_by_pop").alias("missed_pop"),
    )
    return g.join(a, "pathogen", "left").join(b, "pathogen", "left")


def normalize_for_display(summary: DataFrame, fractions: list[str], others: list[str]) -> DataFrame:
    """Fractions clipped to [0, 1], other columns scaled across strategies."""
    out = minmax(summary, {c: f"{c}_norm" for c in others}) if others else summary
    clipped = {f"{c}_norm": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))) for c in fractions}
    return out.withColumns(clipped)


