"""Ranking, deduplication, quotas and budgets of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import CATEGORIES, provenance_rank


def goal_words(goal: str) -> list[str]:
    """Lower-cased words of more than two bytes; repeats stay."""
    return [w for w in goal.lower().split() if len(w.encode()) > 2]


def goal_score(citation: Column, label: Column, goal: str) -> Column:
    """How many of the goal's words occur in citation and label; a repeated word counts twice."""
    text = F.lower(F.concat(citation, F.lit(" "), label))
    return sum((text.contains(w).cast("int") for w in goal_words(goal)), F.lit(0))


def evidence_order(score: str = "goal_score", rank: str = "category_rank", digest: Column | None = None) -> list[Column]:
    """Nearest provenance, newest, best score, category, surest, then by id, entity, digest, citation and label."""
    return [provenance_rank(F.col("provenance")), F.desc("observed_at"), F.desc(score), F.col(rank), F.desc("confidence"), *map(F.col, ("evidence_ref_id", "system", "entity_type", "entity_id")), *([] if digest is None else [digest]), F.col("citation"), F.col("display_label")]


def provenance_order() -> list[Column]:
    """Provenance, newest, id."""
    return [provenance_rank(F.col("provenance")), F.desc("observed_at"), F.col("evidence_ref_id")]


def source_top(df: DataFrame, n: int = 100, entity: list[str] | None = None) -> DataFrame:
    """The best ``n`` rows of a source, one per entity: provenance, newest, id."""
    order = provenance_order()
    best = F.row_number().over(Window.partitionBy(*(entity or ["system", "entity_type", "entity_id"])).orderBy(*order))
    return df.withColumn("_rank", best).filter("_rank = 1").drop("_rank").orderBy(*order).limit(n)


def first_of_equal_keys(df: DataFrame, group: list[str], order: list[Column], keys: list[Column]) -> DataFrame:
    """Without the rows that ``greedy_distinct`` cannot keep: a later row with the same keys as another
    finds at least one of them used.  Rows without any key all stay."""
    marked = df.withColumn("_keys", F.array_compact(F.array(*keys)))
    nth = F.row_number().over(Window.partitionBy(*group, "_keys").orderBy(*order))
    return marked.withColumn("_nth", nth).filter((F.col("_nth") == 1) | (F.size("_keys") == 0)).drop("_keys", "_nth")


def greedy_distinct(df: DataFrame, group: list[str], order: list[Column], keys: list[Column]) -> DataFrame:
    """Row by row in order: keep a row only if no kept row has used one of its keys.

    Dropped rows claim nothing.  The rows of one group (one packet's candidates, which
    its sources bound) are folded as one array, of rows with the same keys only the first.
    """
    df = first_of_equal_keys(df, group, order, keys)
    row = F.struct(F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_at"), F.array_compact(F.array(*keys)).alias("_keys"), F.struct(*df.columns).alias("_row"))
    listed = df.select(*group, row.alias("_item")).groupBy(*group).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<int>").alias("kept"))
    folded = F.aggregate(
        "_items",
        start,
        lambda acc, x: F.when(F.arrays_overlap(acc["used"], x["_keys"]), acc).otherwise(
            F.struct(F.concat(acc["used"], x["_keys"]).alias("used"), F.concat(acc["kept"], F.array(x["_at"])).alias("kept"))
        ),
    )
    kept = F.filter("_items", lambda x: F.array_contains(F.col("_folded")["kept"], x["_at"]))
    out = listed.withColumn("_folded", folded).select(F.explode(kept).alias("_item"))
    return out.select("_item._row.*")


def quotas(most: int) -> dict[str, int]:
    """An equal part of ``most`` for each category; what is left over goes to the first ones."""
    each, left = divmod(most, len(CATEGORIES))
    return {c: each + (i < left) for i, c in enumerate(CATEGORIES)}


def take_quota(df: DataFrame, group: list[str], rank: str, category: str, most: int) -> DataFrame:
    """Each category's quota by rank, then the best of the rest up to ``most``."""
    within = F.row_number().over(Window.partitionBy(*group, category).orderBy(rank))
    limit = F.lit(0)
    for name, n in quotas(most).items():
        limit = F.when(F.col(category) == name, n).otherwise(limit)
    marked = df.withColumn("_in_quota", within <= limit)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_in_quota"), rank))
    return marked.withColumn("_place", place).filter(F.col("_place") <= most).drop("_in_quota", "_place")


def token_estimate(*parts: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((sum((F.octet_length(F.coalesce(p, F.lit(""))) for p in parts[1:]), F.octet_length(F.coalesce(parts[0], F.lit("")))) + 3) / 4).cast("int")


def pack_skipping(df: DataFrame, group: list[str], rank: str, cost: str, budget: int) -> DataFrame:
    """In order of rank, take what still fits and skip what does not."""
    items = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(rank, cost))).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{df.schema[rank].dataType.simpleString()}>").alias("kept"))
    folded = F.aggregate(
        "_items",
        start,
        lambda acc, x: F.when(acc["used"] + x[cost] <= budget, F.struct((acc["used"] + x[cost]).cast("long").alias("used"), F.concat(acc["kept"], F.array(x[rank])).alias("kept"))).otherwise(acc),
    )
    kept = items.select(*group, F.explode(folded["kept"]).alias(rank))
    return df.join(kept, [*group, rank], "left_semi")


def pack_stopping(df: DataFrame, group: list[str], rank: str, cost: str, budget: int) -> DataFrame:
    """In order of rank, take rows up to the first that does not fit."""
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_sum", running).filter(F.col("_sum") <= budget).drop("_sum")


def top_with_ties(df: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """The k best and whatever ties with the last of them."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(score)))).filter(F.col("_rank") <= k).drop("_rank")


def local_share(configured: int, budget: int, floor: int = 1) -> int:
    """What local evidence may use of a budget: the configured part, at most a quarter."""
    return max(floor, min(configured, budget // 4))


def displace(limitations: list[tuple[str, bool]], new: str, most: int) -> tuple[list[tuple[str, bool]], int]:
    """Append a service-authored limitation (text, True); when full it replaces the last
    model-authored one.  Returns the list and how many were displaced or left out."""
    if len(limitations) < most:
        return [*limitations, (new, True)], 0
    for i in range(len(limitations) - 1, -1, -1):
        if not limitations[i][1]:
            return [*limitations[:i], *limitations[i + 1 :], (new, True)], 1
    return limitations, 1
