"""Per-metric ranks and their combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import row_mean, row_median, row_min
from netreach.functions.keys import canon_site
from netreach.functions.scaling import minmax
from netreach.operators.graph import METRICS
from netreach.plans.ordering import competition_rank, number_rows
from netreach.plans.staging import stage


def rank_columns(
    df: DataFrame, metrics: list[str], descending: bool = True, parts: list[str] | None = None, key: str = "wwtp"
) -> DataFrame:
    """rank_<metric> per metric, ties share the minimum, null stays null.

    All metrics are ranked in one pass as (metric, value) rows.  Values are compared at six
    decimals so that summation order cannot decide a tie.
    """
    parts = parts or []
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("v")) for m in metrics])
    )
    long = stage(df.select(*parts, key, pairs.alias("_p")).select(*parts, key, "_p.metric", "_p.v"))
    ranked = competition_rank(long, [*parts, "metric"], "v", "r", ascending=not descending)
    return ranked.groupBy(*parts, key).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"rank_{m}") for m in metrics]
    )


_COMBINE = {"mean": row_mean, "median": row_median, "min": row_min}


def month_rank_table(
    features: DataFrame, risk: DataFrame | None = None, how: str = "mean", parts: list[str] | None = None
) -> DataFrame:
    """Metric ranks, optional combined-risk rank, and their mean, median or minimum."""
    parts = parts or []
    ranks = rank_columns(features.fillna(0.0, METRICS), METRICS, parts=parts)
    cols = [f"rank_{m}" for m in METRICS]
    if risk is not None:
        r = rank_columns(risk.select(*parts, "wwtp", "combined_risk"), ["combined_risk"], parts=parts)
        ranks = ranks.join(r, [*parts, "wwtp"], "full")
        cols.append("rank_combined_risk")
    return ranks.withColumn("final_rank", _COMBINE[how]([F.col(c) for c in cols]))


def order_by_rank(ranks: DataFrame, parts: list[str] | None = None, value: str = "final_rank", name: str = "ord") -> DataFrame:
    """Position 1..n by ascending rank, site name last; null ranks go to the end."""
    return number_rows(ranks, parts or [], [F.coalesce(value, F.lit(float("inf"))), F.col("wwtp")], name)


def rank_lists(ranks: DataFrame, k_list: list[int], parts: list[str] | None = None) -> DataFrame:
    """Full ordered list beside top-k columns."""
    o = order_by_rank(ranks, parts, name="position")
    tops = [F.when(F.col("position") <= k, F.col("wwtp")).alias(f"top{k}") for k in k_list]
    return o.select(*(parts or []), "position", F.col("wwtp").alias("full_list"), *tops)


def ej_rank(features: DataFrame, scores: DataFrame, descending: bool = True) -> DataFrame:
    """Rank by one outside score; of repeated score rows the first (by ``ord``) counts."""
    first = scores.groupBy(canon_site("wwtp").alias("wwtp")).agg(F.min_by("score", "ord").alias("score"))
    joined = features.select("wwtp").join(first, "wwtp", "left")
    r = rank_columns(joined, ["score"], descending)
    return joined.join(r, "wwtp").withColumn("final_rank", F.col("rank_score").cast("double"))


def common_top_sites(ranks: DataFrame, k: int, months: int) -> DataFrame:
    """Number of the last ``months`` months in which a site is among the first k.

    ``row_number() <= k`` is cut to k rows per month before the shuffle.
    """
    recent = ranks.select("year_month").distinct().orderBy(F.desc("year_month")).limit(months)
    w = Window.partitionBy("year_month").orderBy(F.col("final_rank").asc_nulls_last(), "wwtp")
    top = ranks.join(F.broadcast(recent), "year_month").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return top.groupBy("wwtp").agg(F.count(F.lit(1)).alias("months_in_top"))


def risk_rank_columns(cols: list[str]) -> list[str]:
    return [c for c in cols if c.startswith("rank_") and ("risk" in c or "transmission" in c)]


def singleton_importance(
    df: DataFrame, coverage_weight: float = 0.5, risk_weight: float = 0.5, bonus_km: float = 100.0,
    parts: list[str] | None = None,
) -> DataFrame:
    """Score of isolated sites from rank, population, risk rank and isolation."""
    ranks = [c for c in df.columns if c.startswith("rank_")]
    risk = risk_rank_columns(ranks)
    d = df.withColumn("avg_rank", row_mean([F.col(c) for c in ranks]))
    d = d.withColumn("_inv_risk", F.try_divide(F.lit(1.0), row_mean([F.col(c) for c in risk])) if risk else F.lit(None).cast("double"))
    d = minmax(
        d, {"avg_rank": "_mm_rank", "pop_served": "_mm_pop", "pop_covered_by_od": "_mm_cov", "_inv_risk": "_mm_risk"}, parts
    )
    bonus = F.when(F.col("nearest_km") >= bonus_km, 1.0).otherwise(0.0)
    score = (
        (1 - F.col("_mm_rank"))
        + coverage_weight * (0.5 * F.col("_mm_pop") + 0.5 * F.col("_mm_cov"))
        + risk_weight * F.col("_mm_risk")
        + 0.5 * bonus
    )
    return d.withColumn("importance", F.coalesce(score, F.lit(0.0))).drop(
        "_mm_rank", "_mm_pop", "_mm_cov", "_mm_risk", "_inv_risk"
    )


def thresholds(
    ranks: DataFrame, top_pct: float = 0.30, bottom_pct: float = 0.20, parts: list[str] | None = None
) -> DataFrame:
    """top_any: some rank within the top share; bottom_all: every known rank in the bottom share."""
    parts = parts or []
    cols = [c for c in ranks.columns if c.startswith("rank_")]
    n = ranks.groupBy(*parts).agg(*[F.count(c).alias(f"_n_{c}") for c in cols])
    d = ranks.join(n, parts) if parts else ranks.crossJoin(F.broadcast(n))
    pairs = F.filter(F.array(*[F.struct(F.col(c).alias("r"), F.col(f"_n_{c}").alias("n")) for c in cols]),
                     lambda p: p["r"].isNotNull())
    top = F.exists(pairs, lambda p: p["r"] <= F.ceil(F.lit(top_pct) * p["n"]))
    low = F.forall(pairs, lambda p: p["r"] >= F.floor(F.lit(1 - bottom_pct) * p["n"]))
    return d.withColumns({"top_any": top, "bottom_all": low & (F.size(pairs) > 0)}).drop(*[f"_n_{c}" for c in cols])


def cross_ranks(orders: DataFrame, strategy: str, others: list[str]) -> DataFrame:
    """Sites of one strategy with their position in other full orders."""
    own = orders.filter(F.col("strategy") == strategy).select("wwtp", F.col("ord").alias("own_order"))
    rest = (
        orders.filter(F.col("strategy").isin(others)).groupBy("wwtp")
        .agg(*[F.min(F.when(F.col("strategy") == s, F.col("ord"))).alias(f"rank_{s}") for s in others])
    )
    return own.join(rest, "wwtp", "left")


def rank_shade(rank: Column, n: Column) -> Column:
    """1 for the first rank down to 0 for the last."""
    return 1 - F.coalesce(F.try_divide((rank - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0))


def avg_rank_from_month(ranks: DataFrame) -> DataFrame:
    return ranks.select(canon_site("wwtp").alias("wwtp"), F.col("final_rank").alias("avg_rank"))
