"""Reads of versioned rows: the newest per key, the first per key, the latest snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    Spark keeps at most one row per key and task before the shuffle, because the rank
    is filtered to 1.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_version(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """The row of the greatest version per key; ties by the given columns, descending."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in [version, *(ties or [])]])


def latest_snapshot(df: DataFrame, scope: list[str], run: list[Column], run_columns: list[str]) -> DataFrame:
    """All rows of the first run per scope; rows of older runs must not be mixed in."""
    runs = first_per_key(df.select(*scope, *run_columns).distinct(), scope, run)
    return df.join(runs, [*scope, *run_columns], "left_semi")


def fold_ownership(df: DataFrame, keys: list[str], valid_from: str, valid_to: str) -> DataFrame:
    """One window per key: the first start, and the end of the row that starts last;
    an open end beats a closed one, and a null end survives the fold."""
    newest = F.max_by(F.struct(F.col(valid_to)), F.struct(F.col(valid_from), F.col(valid_to).isNull(), F.col(valid_to)))
    return df.groupBy(*keys).agg(F.min(valid_from).alias(valid_from), newest[valid_to].alias(valid_to))


def unambiguous(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs once, and the keys that occur more often with their counts."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("claimants"))
    return df.join(counts.filter("claimants = 1").drop("claimants"), keys, "left_semi"), counts.filter("claimants > 1")
