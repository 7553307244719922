"""Keyset pages over change tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(time: Column, key: Column, since: Column, last_key: Column) -> Column:
    """Rows behind the cursor; at the same time the key decides, compared as bytes."""
    return (time > since) | ((time == since) & (key.cast("string") > last_key))


def page(df: DataFrame, time: str, key: str, n: int, cursor: tuple[Column, Column] | None = None) -> DataFrame:
    """The next ``n`` rows and whether more follow; the probe row itself is not returned."""
    rest = df if cursor is None else df.filter(after(F.col(time), F.col(key), *cursor))
    probe = rest.orderBy(time, F.col(key).cast("string")).limit(n + 1)
    whole = Window.orderBy(time, F.col(key).cast("string"))  # n + 1 rows at most
    return probe.withColumn("_at", F.row_number().over(whole)).withColumn("truncated", F.max("_at").over(Window.partitionBy()) > n).filter(F.col("_at") <= n).drop("_at")


def merged_page(tables: dict[str, DataFrame], time: str, key: str, n: int, cursor: tuple[Column, Column] | None = None) -> DataFrame:
    """One page over many tables: the first ``n`` (time, key) behind the cursor, each with all its rows.

    The cut comes from counts per (time, key), so however many rows share one, none is left
    behind a cursor that has passed them.
    """
    parts = [df.select(F.lit(name).alias("table"), F.col(time).alias("at"), F.col(key).cast("string").alias("key")) for name, df in tables.items()]
    both = reduce(DataFrame.unionByName, parts)
    both = both if cursor is None else both.filter(after(F.col("at"), F.col("key"), *cursor))
    first = both.groupBy("at", "key").count().orderBy("at", "key").limit(n).drop("count")  # n rows at most
    placed = first.select(F.col("at").alias("_at"), F.col("key").alias("_key"), F.row_number().over(Window.orderBy("at", "key")).alias("place"))
    return both.join(placed, F.col("at").eqNullSafe(F.col("_at")) & F.col("key").eqNullSafe(F.col("_key"))).drop("_at", "_key")


def ranked(df: DataFrame, order: list[str], name: str, folder: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... over the whole table in ``order``, without one task that sees it all.

    Rows are sorted within ranges and stored with their place in the range; the ranges' sizes,
    summed in order, say where each begins.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranges.write.parquet(folder)
    stored = spark.read.schema(ranges.schema).parquet(folder).withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = stored.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(sizes, "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_id", "_start")
