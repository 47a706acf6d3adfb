"""The registered queries of this subpackage, each one operator over its whole table, and the SQL of those SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netreach.llm import decontamination, dedup, language_id, license_scan, manifest, mixing, ngram_join, pii, quality, sharding, spelling, toxicity, training_order
from netreach.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.personal_data(read(spark, sf_dir, "documents")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts whose sets of four-word shingles have a Jaccard similarity of at least 0.85."""
    classes = ngram_join.jaccard_classes(read(spark, sf_dir, "documents"), width=4, percent=85)
    return classes.select("doc_id", "n_shingles", "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the corpus's tokens, at most two epochs of any source."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near-equal bytes."""
    return sharding.minimax_shards(read(spark, sf_dir, "documents"), 40).drop("group_key")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's digests, its proof, and the root that a fifth of the rows, tampered with, fold to."""
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_jaccard, op3_exact_dedup, op4_quality, op5_license_scan, op6_decontamination, op7_training_order, op8_toxicity, op9_mixing, op10_sharding, op11_language_id, op12_merkle_manifest, op13_spelling_variants)}

ORACLES = {"op3_exact_dedup": dedup.SQL, "op9_mixing": mixing.sql(), "op12_merkle_manifest": manifest.sql(), "op13_spelling_variants": spelling.sql()}
