"""Values at exact ranks of groups of any size, without a task that orders a whole group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.files import scratch


def values_at_ranks(df: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group: for each name the value at that rank in ascending order, nulls first.

    ``ranks`` gives, from the group's number of rows, a rank from 0.  Equal values are counted
    before anything is sorted; the counts are stored by ranges of (group, value).  Sums per
    range say in which range a rank lies, and only that range's values are added up in order.
    """
    spark = df.sparkSession
    counted = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranged = counted.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id())
    folder = scratch(spark, "ranks")
    ranged.write.parquet(folder)
    stored = spark.read.schema(ranged.schema).parquet(folder)

    same = lambda a, b: reduce(lambda c, g: c & a[g].eqNullSafe(b[g]), group, F.lit(True))
    sizes = stored.groupBy(*group, "_range").agg(F.sum("_n").alias("_size"))
    of_group = Window.partitionBy(*group).orderBy("_range")  # one row per range
    starts = sizes.withColumn("_end", F.sum("_size").over(of_group.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_size").over(Window.partitionBy(*group)))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("_all")).cast("long").alias("rank")) for n, f in ranks.items()]))
    wanted = starts.withColumn("_w", asked).filter((F.col("_w.rank") < F.col("_end")) & (F.col("_w.rank") >= F.col("_end") - F.col("_size")))
    wanted = wanted.select(*group, F.col("_range").alias("_at"), F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_end") + F.col("_size")).alias("_rank"))
    near = stored.join(wanted.withColumnsRenamed({g: f"_of_{g}" for g in group}), reduce(lambda c, g: c & F.col(g).eqNullSafe(F.col(f"_of_{g}")), group, F.col("_range") == F.col("_at")))
    inside = Window.partitionBy(*group, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)  # one range of distinct values
    hit = near.withColumn("_sum", F.sum("_n").over(inside)).filter((F.col("_sum") > F.col("_rank")) & (F.col("_sum") - F.col("_n") <= F.col("_rank")))
    found = hit.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in ranks])
    groups = sizes.select(*group).distinct()
    return groups.join(found, same(groups, found), "left").select(*[groups[g] for g in group], *ranks) if group else found
