"""Shared pieces of the training-data operators: staged tables, size-checked broadcasts, column defaults."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every operator here, as a regex class body.
SPACE = r"[\x20\x09-\x0D]"
#: Most rows a side may have to be broadcast; wider rows than a few numbers lower it.
BROADCAST_ROWS = 200_000


@cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _scratch()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there: cut lineage, columns pruned on reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join.

    ``df`` should be staged, as it is counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_hot(rows: DataFrame, side: DataFrame, key: str, spread_by: str, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (one row for each ``key``), where one key may hold a third of ``rows``.

    Rows are dealt by (key, salt of ``spread_by``); the side is repeated only for pairs that occur.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    pairs = salted.groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one").join(side, key)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")
