"""Gapless positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gapless_rank(df: DataFrame, group: list[str], spread: Column, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each ``group``, by ``spread`` and then ``order``.

    Only the rows of one (group, spread) pair meet in a task; the pairs' row counts,
    summed in order, say where each pair begins.  ``df`` is read twice, so it should
    be a stored table.
    """
    keyed = df.withColumn("_spread", spread)
    sizes = keyed.groupBy(*group, "_spread").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"_of_{g}") for g in group],
        F.col("_spread").alias("_of_spread"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group] + [F.col("_spread") == F.col("_of_spread")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    inside = Window.partitionBy(*group, "_spread").orderBy(*order)
    return (
        keyed.join(starts, condition)
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_spread", "_start", "_of_spread", *[f"_of_{g}" for g in group])
    )
