"""Scaling of one column against its own distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.functions.expr import clip
from netreach.plans.ordering import exact_quantiles


def with_group_stats(df: DataFrame, parts: list[str], stats: DataFrame) -> DataFrame:
    """Attach one-row-per-group statistics (one row in all when ``parts`` is empty)."""
    return df.join(stats, parts, "left") if parts else df.crossJoin(F.broadcast(stats))


def minmax(df: DataFrame, cols: dict[str, str], parts: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min) for each ``source: target``; 0 for a constant or empty column, else null stays null."""
    parts = parts or []
    stats = df.groupBy(*parts).agg(
        *[F.min(c).alias(f"_lo_{t}") for c, t in cols.items()],
        *[F.max(c).alias(f"_hi_{t}") for c, t in cols.items()],
    )
    out = with_group_stats(df, parts, stats)
    scaled = {
        t: F.when(
            F.col(f"_hi_{t}") > F.col(f"_lo_{t}"), (F.col(c) - F.col(f"_lo_{t}")) / (F.col(f"_hi_{t}") - F.col(f"_lo_{t}"))
        ).otherwise(0.0)
        for c, t in cols.items()
    }
    return out.withColumns(scaled).drop(*[f"_lo_{t}" for t in cols.values()], *[f"_hi_{t}" for t in cols.values()])


def quantile_norm(
    df: DataFrame, value: str, name: str, lo: float = 0.01, hi: float = 0.99, parts: list[str] | None = None
) -> DataFrame:
    """(x - q_lo) / (q_hi - q_lo) clipped to [0, 1]; null when both quantiles agree."""
    parts = parts or []
    q = exact_quantiles(df, parts, value, {"_q0": lo, "_q1": hi})
    out = with_group_stats(df, parts, q)
    x = F.try_divide(F.col(value) - F.col("_q0"), F.col("_q1") - F.col("_q0"))
    return out.withColumn(name, clip(x, 0.0, 1.0)).drop("_q0", "_q1")
