"""From documents to packed training sequences, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import classify, jaccard, mixing, packing, pii, positive_unlabelled
from tidemark.llm.queries import TOXIC
from tidemark.llm.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the stage's own input and the labels, then rejects by score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classify.fit_toxicity(docs, labels, positive_unlabelled.PUSettings())
    return classify.kept_below(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; the least doc_id of a group stays."""
    return jaccard.one_of_each_group(docs, jaccard.Similarity(words=5, percent=80))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced by its kind; no document goes."""
    return pii.redacted(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    return packing.pack(docs, packing.public_byte_pairs())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix", mix_to_targets),
    ("pack", pack_sequences),
]

#: The classifier and the mix are not expressible in SQL; tests/llm/test_pipeline.py recounts each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder and read again.

    A stage's table is removed once the next one is written.
    """
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            space.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
