"""Counting rows that are dropped or unreadable in the pass that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, losses: Observation | None, **faults: Column) -> DataFrame:
    """``df``, counting ``rows`` and the rows of each fault into ``losses`` while an action computes it."""
    if losses is None:
        return df
    return df.observe(losses, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items()])
