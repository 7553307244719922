"""What a request shows of its candidates: margin commit, tiers, prompt, cohort, missing kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words of a clarification prompt and how many labels it names.
PROMPT, PROMPT_LABELS = "Which subject did you mean: ", 3


def margin_commit(found: DataFrame, group: list[str], subject: str, eligible: Column, corroborated: Column, threshold: float) -> DataFrame:
    """Per request: the most similar eligible subject, if it leads every other one by the threshold.

    Competitors need not be eligible, so the lead may be negative.  The subject commits only
    when the lexical and the vector search both found it; a lone one never does.
    """
    place = F.struct((-F.col("similarity")).alias("below"), F.col(subject).alias("subject"))
    top = found.groupBy(*group).agg(F.min(F.when(eligible, place)).alias("_top"), F.min_by(corroborated, F.when(eligible, place)).alias("_both"))
    other = found.join(top, group).groupBy(*group, "_top", "_both").agg(F.min(F.when(F.col(subject) != F.col("_top.subject"), -F.col("similarity"))).alias("_next"))
    margin = -F.col("_top.below") + F.col("_next")
    good = F.coalesce(F.col("_both") & (margin >= threshold), F.lit(False))
    return other.select(*group, F.when(good, F.col("_top.subject")).alias("committed"), margin.alias("margin"))


def tiered(candidates: DataFrame, group: list[str], subject: str, order: list[Column], committed: Column, parents: DataFrame, most: int) -> DataFrame:
    """Committed subjects first, then parents of observed ones, then the rest, each in their order; at most so many.

    parents: (group, subject) of what observation candidates belong to.
    """
    known = parents.select(*group, subject).distinct().withColumn("_parent", F.lit(True))
    df = candidates.join(known, [*group, subject], "left")
    df = df.withColumn("tier", F.when(committed, 0).when(F.col("_parent"), 1).otherwise(2)).drop("_parent")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("tier", *order))).filter(F.col("place") <= most)


def clarification(candidates: DataFrame, group: list[str], label: str, order: list[Column]) -> DataFrame:
    """A question that names the first labels of each request."""
    top = candidates.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_place") <= PROMPT_LABELS)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("_place", label))), lambda x: x[label])
    return top.groupBy(*group).agg(F.concat(F.lit(PROMPT), F.array_join(labels, ", "), F.lit("?")).alias("prompt"))


def cohort(nodes: DataFrame, group: list[str], subject: str, arrival: str, most: int) -> DataFrame:
    """Distinct subjects by first arrival, ranked from 1 and cut at ``most``; complete if fewer were found."""
    first = nodes.groupBy(*group, subject).agg(F.min(arrival).alias("_at"))
    w = Window.partitionBy(*group).orderBy("_at", subject)
    ranked = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("_at")
    count = first.groupBy(*group).agg((F.count("*") < most).alias("complete"))
    return ranked.join(count, group)


def missing_kinds(found: DataFrame, group: list[str], kind: str, required: list[str]) -> DataFrame:
    """Per request: the required kinds no candidate has, in their order."""
    return found.groupBy(*group).agg(F.array_except(F.array(*map(F.lit, required)), F.collect_set(kind)).alias("missing"))


def with_derived(roots: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """All roots as they are, then each derived subject that is no root, once."""
    fresh = derived.dropDuplicates(keys).join(roots.select(*keys).distinct(), keys, "left_anti")
    return roots.withColumn("origin", F.lit("root")).unionByName(fresh.withColumn("origin", F.lit("derived")))


def coarsest_grain(df: DataFrame, group: list[str], grain: str) -> DataFrame:
    """``day`` if any part is of that grain, else the one that is stated, else null."""
    return df.groupBy(*group).agg(F.when(F.bool_or(F.col(grain) == "day"), "day").otherwise(F.min(F.nullif(F.col(grain), F.lit("")))).alias("grain"))


def ordered_edges(edges: DataFrame, group: list[str], confidence: Column, edge_id: str) -> DataFrame:
    """Edges by confidence, the surest first, ties by id."""
    df = edges.withColumn("confidence", confidence)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("confidence"), edge_id)))


def capped_facts(facts: DataFrame, kinds: list[str], per_kind: int = 200, most: int = 2000) -> DataFrame:
    """So many facts of each kind and in all, by kind in the given order, subject kind, id and source.

    Only the first rows of each kind leave a task; what is sorted in all is bounded by the limits.
    """
    within = [F.col(c) for c in ("subject_kind", "subject_id", "source")]
    nth = F.row_number().over(Window.partitionBy("fact_kind").orderBy(*within))
    ordinal = reduce(lambda out, k: F.when(F.col("fact_kind") == k[1], k[0]).otherwise(out), enumerate(kinds), F.lit(len(kinds)))
    few = facts.withColumn("_nth", nth).filter(F.col("_nth") <= per_kind).drop("_nth")
    return few.withColumn("kind_ordinal", ordinal).orderBy("kind_ordinal", *within).limit(most)
