"""A training corpus from raw documents: toxic texts and near-copies go, then benchmark passages; sources are mixed and sharded.

Each stage takes ``documents`` as its predecessor left it, and the folder of the input tables, where it finds labels and
benchmark items. All but the last return the columns they were given. ``run`` writes each stage's rows to the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netreach.llm import decontamination, mixing, ngram_join, sharding, toxicity
from netreach.llm.common import read, small, stage

#: Shards of the finished corpus, tokens kept by the mix as a share of its input's, words of a shingle, similarity in percent.
SHARDS, KEPT_TOKENS, SHINGLE, SIMILAR = 40, 0.9, 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below 0.5 for toxicity."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-copies the document that names it; texts without words have no copies and stay."""
    classes = ngram_join.jaccard_classes(docs, width=SHINGLE, percent=SIMILAR)
    gone = stage(classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "near-copies")
    doc_id = F.col("doc_id").cast("long")
    return docs.join(small(gone.withColumnRenamed("doc_id", "_gone")), doc_id == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most one epoch of each source, by target weights."""
    return mixing.mix_documents(docs, fraction=KEPT_TOKENS, max_epochs=1)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.minimax_shards(docs, SHARDS).drop("group_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL cannot state the classifier nor the edit search; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
