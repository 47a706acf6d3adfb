"""One-step forecast of every node on its own past, its neighbours' past and the season, with a ridge model.

The model is linear, so one pass over the training rows gives all it needs: the mean product of every pair of columns.
That table of numbers serves every ridge value, and solving it is a system of as many equations as there are columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.operators.network import diff_spike, diffuse, fourier, inverse_target, rolling_mean, scale, scale_stats, time_split, windows
from netreach.plans.staging import stage


def columns(seq_len: int, harmonics: int = 2) -> list[str]:
    """The model's inputs: own lags, one and two hops of the graph, a jump of the last step, the season."""
    waves = [f"{w}_{k}" for k in range(1, harmonics + 1) for w in ("sin", "cos")]
    return [*[f"lag{k}" for k in range(seq_len, 0, -1)], "hop1", "hop2", "spike1", *waves]


def scaled_series(series: DataFrame, trend: int = 1) -> tuple[DataFrame, DataFrame]:
    """(t, node, split, x, z) with z scaled by the node's training steps, and the (node, mean, std) it was scaled by."""
    d = time_split(rolling_mean(series, "x", trend, "x") if trend > 1 else series)
    stats = stage(scale_stats(d.filter(F.col("split") == "train"), ["x"], ["x"], ["node"]))
    z = scale(d, stats, ["x"], ["x"], ["node"]).withColumnRenamed("x_scaled", "z")
    dev = F.when(F.col("_s_x") > 1e-12, F.col("_s_x")).otherwise(1.0)
    return stage(z.select("t", "node", "split", "x", "z")), stats.select("node", F.col("_m_x").alias("mean"), dev.alias("std"))


def training_table(
    series: DataFrame, edges: DataFrame, seq_len: int = 4, trend: int = 1, period: int = 52, harmonics: int = 2, max_gap_weeks: int = 2,
) -> DataFrame:
    """Model inputs and target of every (t, node) whose window is whole, with the split, staged.

    ``series``: (t, node, x); ``edges``: (t, src, dst, w), row src reads from dst.  ``prev`` is the step before in the
    node's own series, the one that hops and lag1 are taken from.
    """
    z, stats = scaled_series(series, trend)
    spikes = diff_spike(z.select("t", "node", "z"), ["z"]).select("t", "node", F.col("z_spike").cast("double").alias("z_spike"))
    d = stage(diffuse(edges, z, ["z"], 2).join(spikes, ["t", "node"]))
    last = Window.partitionBy("node").orderBy("t")
    before = d.select("t", "node", F.lag("t").over(last).alias("prev"), *[
        F.lag(c).over(last).alias(n) for c, n in (("z_hop1", "hop1"), ("z_hop2", "hop2"), ("z_spike", "spike1"))])
    out = windows(d, "z", seq_len, max_gap_weeks).join(before, ["t", "node"]).join(fourier(z.select("t", "node", "split", "x"), period, harmonics), ["t", "node"])
    lags = [F.col("inputs")[i].alias(f"lag{seq_len - i}") for i in range(seq_len)]
    waves = [c for c in columns(seq_len, harmonics) if c.startswith(("sin_", "cos_"))]
    return stage(out.join(stats, "node").select(
        "t", "node", "prev", "split", "x", "target", "weight", *lags, "hop1", "hop2", "spike1", *waves, "mean", "std"))


@dataclass(frozen=True)
class Moments:
    """Weighted means of the columns, the target last, and of the products of each two."""

    names: list[str]
    mean: np.ndarray
    product: np.ndarray

    def solve(self, ridge: float) -> LinearModel:
        """The least mean squared error plus ``ridge`` x squared coefficients."""
        spread = self.product - np.outer(self.mean, self.mean)
        k = len(self.names)
        slope = np.linalg.solve(spread[:k, :k] + ridge * np.eye(k), spread[:k, k])
        return LinearModel(dict(zip(self.names, slope.tolist(), strict=True)), float(self.mean[k] - slope @ self.mean[:k]))


@dataclass(frozen=True)
class LinearModel:
    coefficients: dict[str, float]
    intercept: float

    def score(self) -> Column:
        """The scaled forecast as a projection of the table's columns."""
        z = F.lit(self.intercept)
        for name, b in self.coefficients.items():
            z = z + F.lit(b) * F.col(name)
        return z


def moments(table: DataFrame, features: list[str]) -> Moments:
    """One aggregate over the training rows; the driver sees one row of a few hundred numbers."""
    names = [*features, "target"]
    w = F.col("weight")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = table.filter(F.col("split") == "train").agg(
        F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)],
        *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    if not row["n"]:
        raise ValueError("no training rows: every window is too short or broken by a gap")
    product = np.zeros((len(names), len(names)))
    for i, j in pairs:
        product[i, j] = product[j, i] = row[f"p{i}_{j}"] / row["n"]
    return Moments(features, np.array([row[f"s{i}"] / row["n"] for i in range(len(names))]), product)


def fit(table: DataFrame, features: list[str], ridge: float = 0.01) -> LinearModel:
    """Ridge regression on the training split."""
    return moments(table, features).solve(ridge)


def predict(model: LinearModel, table: DataFrame) -> DataFrame:
    """pred, truth and mask per (t, node) on the original scale, with the inputs it came from."""
    z = model.score()
    return table.select("t", "node", "prev", "split", inverse_target(z, F.col("mean"), F.col("std")).alias("pred"), F.col("x").alias("truth"),
                        F.col("weight").alias("mask"), z.alias("pred_scaled"), *model.coefficients)


def pred_vs_true(pred: DataFrame) -> DataFrame:
    """Long table with the splits train, test and all."""
    base = pred.select("t", "node", "split", "pred", "truth", "mask")
    return base.withColumn("split", F.explode(F.array("split", F.lit("all"))))
