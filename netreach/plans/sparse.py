"""Matrices as edge lists (keys..., src, dst, w); absent cells are zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import ratio
from netreach.plans.staging import stage


def row_normalize(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Divide by the row sum; a row without weight stays absent.

    The cells are already summed by (row, column), so a row is at most as long as the node list
    and one shuffle by row does it.
    """
    row = Window.partitionBy(*(by or []), "src")
    return edges.withColumn("w", ratio(F.col("w"), F.sum("w").over(row))).filter(F.col("w").isNotNull())


def product(left: DataFrame, right: DataFrame, by: list[str] | None = None, spread: int = 4) -> DataFrame:
    """Matrix product left x right per ``by`` group.

    Both factors are salted: rows of the left by a hash of the row, columns of the right by a
    hash of the column, each side copied to the other's ``spread`` salts.  A middle node that
    holds a large share of all edges is thus met by spread x spread tasks, and products are
    summed by (row, column) before they are shuffled.
    """
    by = by or []
    salts = F.sequence(F.lit(0), F.lit(spread - 1))
    a = left.groupBy(*by, "src", "dst").agg(F.sum("w").alias("wa")).select(
        *by, F.col("src").alias("i"), F.col("dst").alias("k"), "wa",
        F.pmod(F.xxhash64("src"), F.lit(spread)).cast("int").alias("ri"), F.explode(salts).alias("cj"))
    b = right.groupBy(*by, "src", "dst").agg(F.sum("w").alias("wb")).select(
        *by, F.col("src").alias("k"), F.col("dst").alias("j"), "wb",
        F.pmod(F.xxhash64("dst"), F.lit(spread)).cast("int").alias("cj"), F.explode(salts).alias("ri"))
    return a.join(b, [*by, "k", "ri", "cj"]).groupBy(*by, F.col("i").alias("src"), F.col("j").alias("dst")).agg(
        F.sum(F.col("wa") * F.col("wb")).alias("w"))


def mean_over(edges: DataFrame, t: str = "t") -> DataFrame:
    """Mean matrix over all time steps, absent cells counted as zero."""
    edges = stage(edges)
    n = edges.agg(F.count_distinct(t).alias("_n"))
    s = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return s.crossJoin(F.broadcast(n)).select("src", "dst", (F.col("w") / F.col("_n")).alias("w"))
