"""Cutting lineage with reliable checkpoints.

Iterative operators and tables that several branches read again are written once to the
checkpoint folder the cluster names, so a lost executor costs a re-read and not a rerun.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(root)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and return a DataFrame that reads the copy.

    Join sides that turn out small at run time are broadcast by adaptive execution, which
    knows the measured size of every shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str = "table") -> DataFrame:
    """As ``stage``, but written by columns, so a large table takes less disk and joins know its size.

    Order and partitions of ``df`` are not kept.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that has fewer tasks than the cluster has cores; large scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, shared by driver and executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}/{name}"
