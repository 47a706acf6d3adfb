"""Exact deduplication by a persistent digest index.

The index is a table of one row for each distinct text, bucketed and sorted by digest. A batch is reduced to its own
distinct digests, anti-joined with the index bucket by bucket (the index side is neither shuffled nor sorted again) and
what is left is appended. Null counts as empty text; texts are equal when they are identical after each run of white
space becomes one space. A null ``doc_id`` is the largest id. Repeated rows count each. Other columns are ignored.
An empty batch leaves the index as it is and an empty table gives no rows.

Hot groups: a third of all rows may share one digest. Counts are summed first by (digest, salt), so that a digest
brings at most ``SALTS`` rows into any task, and rows get their group's values back by the same pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netreach.llm.common import SPACE, shared_path, stage, text_or_empty

#: Rows of one digest are spread over so many keys.
SALTS = 64


def digest(column: str = "text") -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), SPACE + "+", " "), 256))


class DigestIndex:
    """One row (digest, keep_id) for each text seen, in a table bucketed and sorted by digest at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame) -> None:
        """Append the digests of a batch (doc_id, digest, salt) that the index lacks, each with its smallest id."""
        # staged, as the optimizer would else put the join below both sums and bring all rows of a digest together
        first = stage(
            digests.groupBy("digest", "salt").agg(F.min("doc_id").alias("keep_id"))
            .groupBy("digest").agg(F.min("keep_id").alias("keep_id")), "first-digests"
        )
        new = first.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id")
        (new.repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))


def with_digests(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), digest().alias("digest"),
        F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("salt"),
    )


def exact_dedup(docs: DataFrame, batches: int = 2, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows enter a fresh index in ``batches`` batches of ascending ``doc_id``, so the row that came first, which has
    the smallest id, is the one that stays. Of rows with equal text and equal smallest id, all are marked kept only if
    they are one row; repeats of the same id are numbered and the first stays.
    """
    spark = docs.sparkSession
    digests = stage(with_digests(docs), "digests")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, path or shared_path(spark, "digest-index"), buckets)
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:  # no id at all
        low, high, batches = 0, 0, 1
    cuts = [low + (high - low + 1) * k // batches for k in range(1, batches)]
    for k in range(batches):
        part = digests
        if k:
            part = part.where((F.col("doc_id") >= cuts[k - 1]) | (F.col("doc_id").isNull() if k == batches - 1 else F.lit(False)))
        if k < batches - 1:
            part = part.where(F.col("doc_id") < cuts[k])
        index.ingest(part)
    counts = digests.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("digest").agg(F.sum("n").alias("group_size"))
    groups = index.rows().join(sizes, "digest")
    by_salt = counts.select("digest", "salt").join(groups, "digest")
    rows = digests.groupBy("digest", "salt", "doc_id").agg(F.count("*").alias("copies"))
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (
        rows.join(by_salt, ["digest", "salt"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id", "keep_id", "group_size", (keeper & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
