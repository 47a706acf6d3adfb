"""Labelled rows for the classifiers: the held-out rule and a bounded, reproducible sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import stage


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, text, label 0 or 1), staged: of each class the ``most`` ids with the smallest hashes that are not held out.

    An id with several labels counts with the largest; null ids and null labels are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(folds, fold))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    of_class = [known.where(F.col("label") == k).orderBy("_h", "doc_id").limit(most) for k in (0, 1)]
    ids = of_class[0].unionByName(of_class[1]).drop("_h")  # at most 2 x most rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "training")
