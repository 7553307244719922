"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classify, factorisation, fill_in_middle, jaccard, katz, mixing, near_vectors, packing, pii, positive_unlabelled, repetition, shard, token_files, vector_codes

SHARDS = 40
TOXIC = 0.7
METADATA = ("n_chars",)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classify.fit_quality(docs, _table(spark, sf_dir, "labels"), factorisation.FMSettings(), METADATA)
    return classify.scored(docs, model, 0.5, METADATA)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classify.fit_toxicity(docs, _table(spark, sf_dir, "labels"), positive_unlabelled.PUSettings())
    return classify.scored(docs, model, TOXIC)


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents")).drop("worst_share")


def op8_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), jaccard.Similarity(words=3, percent=90))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.public_byte_pairs())


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op11_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), token_files.public_word_pieces())


def op12_bit_parallel_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(_table(spark, sf_dir, "documents"))


def op13_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sorted_projection_dedup, op2_factorisation_quality, op3_rendezvous_shards, op4_pii_spans, op5_pivotal_mix, op6_pu_toxicity, op7_repetition_coverage, op8_count_tree_jaccard, op9_best_fit_packing, op10_katz_backoff, op11_orc_token_files, op12_bit_parallel_middle, op13_heap_lloyd_codes)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in queries()}
