"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it has more than one row in so many, so there are fewer heavy keys than this.
SHARE = 64


def join_by_share(rows: DataFrame, side: DataFrame, key: str, count: str, share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``side``, one row for each ``key`` with the ``count`` of its rows; both staged.

    Rows of heavy keys stay where they are and meet the few heavy rows of ``side`` by broadcast; a task of the
    shuffled rest has no key of more than one row in ``share``.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > total / share
    top = F.broadcast(side.filter(heavy).limit(share))  # fewer than ``share`` keys can be heavy
    rest = rows.join(top.select(key), key, "left_anti").join(side.filter(~heavy), key)
    return rows.join(top, key).unionByName(rest)
