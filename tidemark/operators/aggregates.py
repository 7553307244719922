"""Aggregations: watermarks, consensus, priors, percentiles, recall, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import values_at_ranks
from .temporal import freshness


def watermarks(evidence: DataFrame, catalog: DataFrame, source: str, observed: str, at: Column) -> DataFrame:
    """Newest row and freshness of every source in the catalog, also of those without rows."""
    seen = evidence.groupBy(source).agg(F.max(observed).alias("watermark"))
    return catalog.join(seen, source, "left").withColumn("freshness", freshness(F.col("watermark"), at))


def coverage(evidence: DataFrame, group: list[str], source: str, available: Column) -> DataFrame:
    """Sorted distinct sources: considered, available and not."""
    sets = {"considered": F.lit(True), "available": available, "unavailable": ~available}
    return evidence.groupBy(*group).agg(*[F.array_sort(F.collect_set(F.when(c, F.col(source)))).alias(n) for n, c in sets.items()])


def census(df: DataFrame, identity: str, group: list[str] | None = None) -> DataFrame:
    """How many rows satisfy, and which one if it is the only one."""
    return df.groupBy(*(group or [])).agg(F.count("*").alias("satisfiers"), F.when(F.count("*") == 1, F.min(identity)).alias("only"))


def consensus(votes: DataFrame, group: list[str], voter: str, value: str) -> DataFrame:
    """The plurality value (ties: the least), who voted, and whether all agree."""
    counted = votes.groupBy(*group, value).agg(F.count("*").alias("votes"))
    best = counted.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("votes"), F.col(value))).alias("majority"), F.max("votes").alias("agreeing"))
    voters = votes.groupBy(*group).agg(F.count("*").alias("panel"), F.count_distinct(voter).alias("voters"))
    return best.join(voters, group).withColumn("unanimous", F.col("agreeing") == F.col("panel"))


def curate_priors(selections: DataFrame, group: list[str], value: str, mode: str, human: str) -> DataFrame:
    """Values chosen by at least one human, ranked from 0 by human, then all choices, then value."""
    counted = selections.groupBy(*group, value).agg(F.count_if(F.col(mode) == human).alias("human"), F.count("*").alias("total")).filter("human >= 1")
    order = Window.partitionBy(*group).orderBy(F.desc("human"), F.desc("total"), value)
    return counted.withColumn("rank", F.row_number().over(order) - 1)


def _beside(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Both of one row per group; null keys are keys."""
    named = right.withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = reduce(lambda c, g: c & F.col(g).eqNullSafe(F.col(f"_of_{g}")), group, F.lit(True))
    return left.join(named, same).drop(*[f"_of_{g}" for g in group])


def timing_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, upper median (the element at n / 2 from 0) and greatest."""
    middle = values_at_ranks(df.select(*group, value), group, value, {"p50": lambda n: F.floor(n / 2)})
    rest = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("calls"))
    return _beside(rest, middle, group).select(*group, "mean", "p50", "most", "calls")


def nearest_rank(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """The value at ceil(f n), counted from 1; nulls do not count."""
    at = {name: (lambda n, f=f: F.greatest(F.lit(1), F.ceil(n * f)) - 1) for name, f in fractions.items()}
    found = values_at_ranks(df.select(*group, value).filter(F.col(value).isNotNull()), group, value, at)
    missing = df.groupBy(*group).agg(F.max(value).alias("_any")).filter("_any IS NULL").select(*group, *[F.col("_any").alias(n) for n in fractions])
    return found.unionByName(missing)


def floor_index(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """The value at floor(f n), counted from 1 and at least the first: not the nearest rank."""
    at = {name: (lambda n, f=f: F.greatest(F.lit(1), F.floor(n * f)) - 1) for name, f in fractions.items()}
    return values_at_ranks(df.select(*group, value), group, value, at)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def recall_at(truth: DataFrame, found: DataFrame, group: list[str], item: str, score: str, k: int) -> DataFrame:
    """Share of the k best true items that are found; with ties, found items as good as the k-th count too."""
    order = Window.partitionBy(*group).orderBy(F.desc(score))
    top = truth.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), item))).withColumn("_tied", F.rank().over(order))
    both = top.filter(F.col("_tied") <= k).join(found.select(*group, item, F.lit(True).alias("_hit")), [*group, item], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return both.groupBy(*group).agg(
        F.try_divide(F.count_if(hit & (F.col("_rank") <= k)), F.count_if(F.col("_rank") <= k)).alias("recall"),
        F.least(F.lit(1.0), F.try_divide(F.count_if(hit), F.count_if(F.col("_rank") <= k))).alias("tolerant_recall"),
    )


def usage(df: DataFrame, group: list[str], time: str, width: str, amount: str) -> DataFrame:
    """Totals per aligned window and group."""
    w = F.window(F.col(time), width)
    return df.groupBy(w.alias("_w"), *group).agg(F.count("*").alias("requests"), F.sum(amount).alias("amount")).select(F.col("_w.start").alias("window_start"), *group, "requests", "amount")


def merge_shards(shards: DataFrame, group: list[str], sums: list[str], tags: str, started: str, valid: str) -> DataFrame:
    """Counters add up, the earliest start counts, tags unite, one invalid shard spoils all."""
    return shards.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums], F.min(started).alias(started), F.array_sort(F.collect_set(tags)).alias("tags"), F.bool_and(valid).alias(valid))


def set_equality(expected: DataFrame, actual: DataFrame, group: list[str], item: str) -> DataFrame:
    """Per group: items missing and unexpected, and whether both sets are equal."""
    a = expected.select(*group, item).distinct().withColumn("_e", F.lit(1))
    b = actual.select(*group, item).distinct().withColumn("_a", F.lit(1))
    both = a.join(b, [*group, item], "full")
    return both.groupBy(*group).agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected")).withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))
