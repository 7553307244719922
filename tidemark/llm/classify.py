"""Fitting text classifiers on bounded labelled samples, and scoring whole tables with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import factorisation, positive_unlabelled
from .blobs import release
from .features import STATS, Rows, slices, sparse_rows
from .workspace import ship_package

FOLDS, HELD_OUT = 3, 1


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds


def held_out(key: Column) -> Column:
    return remainder(key, FOLDS) == HELD_OUT


def _numbers(batch: pa.RecordBatch, metadata: tuple[str, ...]) -> np.ndarray:
    """log(1 + x) of each numeric metadata column; null and negative count as 0."""
    out = [pd.to_numeric(batch.column(c).to_pandas(), errors="coerce").fillna(0).clip(lower=0).to_numpy(np.float64) for c in metadata]
    return np.log1p(np.stack(out, axis=1)) if out else np.zeros((batch.num_rows, 0))


def _batch_rows(batch: pa.RecordBatch, text: str, bits: int, prefixes: tuple[int, ...], metadata: tuple[str, ...]) -> Iterator[Rows]:
    extra, at = _numbers(batch, metadata), 0
    for data, offsets in slices(batch.column(text)):
        rows = sparse_rows(data, offsets, bits, prefixes)
        n = len(offsets) - 1
        rows.dense = np.concatenate([rows.dense, extra[at : at + n]], axis=1)
        at += n
        yield rows
        release()


def sample_rows(docs: DataFrame, wanted: DataFrame, bits: int, prefixes: tuple[int, ...], metadata: tuple[str, ...], key: str, text: str, counted: bool = True) -> tuple[Rows, pd.DataFrame]:
    """Features of the documents in ``wanted`` (doc_id and marks, few rows by its limit), in order of doc_id.

    The join scans ``docs`` once without a shuffle; of repeated keys the least text counts.
    Without ``counted`` the counts of features stay behind.
    """
    marks = [c for c in wanted.columns if c != "doc_id"]
    found = (
        docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *metadata)
        .join(F.broadcast(wanted), "doc_id")
        .groupBy("doc_id", *marks)
        .agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in metadata])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[bytes, bytes, bytes]] = []
            for rows in _batch_rows(batch, "text", bits, prefixes, metadata):
                for a, b, dense in zip(rows.starts[:-1], rows.starts[1:], rows.dense, strict=True):
                    made.append((rows.ids[a:b].tobytes(), rows.counts[a:b].tobytes() if counted else b"", dense.tobytes()))
            columns = [batch.column("doc_id"), *(batch.column(m) for m in marks), *(pa.array([x[i] for x in made], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *marks, "ids", "counts", "dense"])

    schema = ", ".join(["doc_id long", *(f"{m} {wanted.schema[m].dataType.simpleString()}" for m in marks), "ids binary, counts binary, dense binary"])
    frame = found.mapInArrow(run, schema).toPandas().sort_values(["doc_id", *marks]).reset_index(drop=True)
    ids = [np.frombuffer(x, np.int32) for x in frame.ids]
    counts = [np.frombuffer(x, np.float32) for x in frame.counts]
    dense = [np.frombuffer(x, np.float64) for x in frame.dense]
    if not len(frame):
        return Rows(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, STATS + len(metadata)))), frame
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return Rows(starts, np.concatenate(ids), np.concatenate(counts), np.stack(dense)), frame[["doc_id", *marks]]


def few(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows with distinct doc_id, chosen by a hash of it: the same ones on every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows to learn from; of repeated ids the greatest label counts."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: factorisation.FMSettings, metadata: tuple[str, ...], key: str = "doc_id", text: str = "text") -> factorisation.FactorisationMachine:
    ship_package(docs.sparkSession)
    wanted = few(training_labels(labels, "quality"), settings.examples)
    rows, frame = sample_rows(docs, wanted, settings.bits, settings.prefixes, metadata, key, text)
    return factorisation.train(rows, frame["label"].to_numpy(np.float64), settings)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: positive_unlabelled.PUSettings, key: str = "doc_id", text: str = "text") -> positive_unlabelled.LinearModel:
    """Positives: labelled toxic.  Unlabelled: rows of the labels table of any kind, their labels unread.

    Both samples are bounded by settings; a share of positives is estimated from scores."""
    ship_package(docs.sparkSession)
    known = training_labels(labels, "toxic")
    unlabelled = few(known.select("doc_id"), settings.unlabelled)
    positives = few(known.filter("label = 1").select("doc_id"), settings.positives)
    wanted = positives.withColumn("label", F.lit(1)).unionByName(unlabelled.withColumn("label", F.lit(0)))
    rows, frame = sample_rows(docs, wanted, settings.bits, settings.prefixes, (), key, text, counted=False)
    positive = frame["label"].to_numpy() == 1
    prior = settings.prior if settings.prior is not None else positive_unlabelled.estimated_prior(rows, positive, frame["doc_id"].to_numpy(), settings)
    return positive_unlabelled.train(rows, positive, prior, settings)


def _scorer(model, text: str, metadata: tuple[str, ...]) -> Callable[[pa.RecordBatch], np.ndarray]:
    def scores(batch: pa.RecordBatch) -> np.ndarray:
        s = model.settings
        parts = [model.scores(rows) for rows in _batch_rows(batch, text, s.bits, s.prefixes, metadata)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return scores


def scored(docs: DataFrame, model, threshold: float, metadata: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is scored as an empty one.  Texts are read whole; repeated rows get
    equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, "text", metadata)
        for batch in batches:
            got = score(batch)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), docs[text].cast("string").alias("text"), *metadata)
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept_below(docs: DataFrame, model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, text, ())
        for batch in batches:
            yield batch.filter(pa.array(score(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)
