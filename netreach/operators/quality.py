"""Run-time checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` or raise with a few duplicate keys."""
    bad = duplicate_keys(df, keys).take(5)
    if bad:
        raise ValueError(f"duplicate keys {[r.asDict() for r in bad]}")
    return df


def assert_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str) -> None:
    """Check ``1:1``, ``1:m`` or ``m:1`` before a join."""
    one_left, one_right = validate.split(":")
    if one_left == "1":
        assert_unique(left, keys)
    if one_right == "1":
        assert_unique(right, keys)


def reconcile(
    parts: DataFrame, total: DataFrame, keys: list[str], part_value: str, total_value: str, tol: float = 1e-6
) -> DataFrame:
    """Sum of parts against totals, both sides of the key kept."""
    p = parts.groupBy(*keys).agg(F.sum(part_value).alias("sum_parts"))
    t = total.select(*keys, F.col(total_value).alias("total"))
    j = p.join(t, keys, "full")
    diff = F.abs(F.coalesce("sum_parts", F.lit(0.0)) - F.coalesce("total", F.lit(0.0)))
    side = (
        F.when(F.col("sum_parts").isNull(), "total_only").when(F.col("total").isNull(), "parts_only").otherwise("both")
    )
    return j.withColumns({"abs_diff": diff, "side": side, "ok": (side == "both") & (diff <= tol)})


def reconcile_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("abs_diff").alias("max_abs_diff"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("side") != "both").alias("one_sided"),
    )


def assert_reconciled(diff: DataFrame) -> DataFrame:
    row = reconcile_summary(diff).first()
    if row["failed"]:
        raise ValueError(f"totals do not reconcile: {row.asDict()}")
    return diff


def monthly_consistency(
    tables: dict[str, DataFrame], keys: list[str], values: list[str], tol: float = 1e-6
) -> DataFrame:
    """Largest difference of every other table to the first, with missing keys counted."""
    names = list(tables)
    base = tables[names[0]].select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values])
    out = None
    for name in names[1:]:
        other = tables[name].select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_here"))
        j = base.withColumn("_base", F.lit(True)).join(other, keys, "full")
        row = j.agg(
            F.count_if(F.col("_here").isNull()).alias("missing"),
            F.count_if(F.col("_base").isNull()).alias("extra"),
            F.max(F.greatest(*[F.abs(F.col(f"_b_{v}") - F.col(f"_o_{v}")) for v in values], F.lit(0.0))).alias("max_abs_diff"),
        ).select(F.lit(name).alias("table_name"), "missing", "extra", "max_abs_diff")
        out = row if out is None else out.unionByName(row)
    ok = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("max_abs_diff") <= tol)
    return out.withColumn("ok", ok)


def fractions_ok(weights: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Rows whose covered and outside shares do not sum to one."""
    return weights.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(F.col("covered_prop") + F.col("outside_prop") - 1) > tol).alias("failed"),
    )


def state_total_ok(total_pop: DataFrame, covered: DataFrame, uncovered: DataFrame, tol: float = 1e-4) -> DataFrame:
    """covered + uncovered as a percentage of the total, from three one-row tables."""
    j = total_pop.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(uncovered))
    pct = 100 * F.try_divide(F.col("covered") + F.col("uncovered"), F.col("total"))
    return j.select(pct.alias("pct"), (F.abs(pct - 100) <= tol).alias("ok"))


def share_sums_ok(shares: DataFrame, key: str, share: str, tol: float = 1e-6) -> DataFrame:
    """Groups whose shares do not sum to one."""
    s = shares.groupBy(key).agg(F.sum(share).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.abs(F.col("s") - 1) > tol).alias("failed"))
