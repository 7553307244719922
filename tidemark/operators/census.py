"""Census rounds: is there exactly one row that a question's handle and anchor can mean?

Many questions are answered at once.  Rows are counted per key before they meet the
questions, so a key with very many rows costs one row of the join.  The counts come from one
reading of the tables and the keys from another; where the two disagree nothing is decided.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.files import stored

#: Fixed value: up to so many satisfiers are listed.
BUDGET = 999
#: Why a round decides nothing.
HISTORICAL, SCOPED, MULTI_HANDLE, NO_DISCRIMINATORS = "historical_axis_skip", "scoped_visibility", "multi_handle", "no_discriminators"
UNREGISTERED, MISMATCH = "census_kind_unregistered", "census_closure_mismatch"


@dataclass(frozen=True)
class Kind:
    """A census kind: its table, the columns that make its identity, its handle and anchors, its time."""

    table: str
    identity: tuple[str, ...]
    handle: str | None
    anchors: dict[str, str]
    time: str


KINDS = {
    "pull_request": Kind("git_pull_requests", ("org_id", "repo_id", "number"), "number", {"repository": "repo_id"}, "created_at"),
    "work_item": Kind("work_items", ("org_id", "repo_id", "work_item_id"), "work_item_id", {"project": "project_id"}, "created_at"),
    "ci_run": Kind("ci_pipeline_runs", ("org_id", "repo_id", "run_id"), "run_id", {"repository": "repo_id"}, "started_at"),
    "pull_request_review": Kind("git_pull_request_reviews", ("org_id", "repo_id", "number", "review_id"), None, {"repository": "repo_id"}, "submitted_at"),
}


def census_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, org_id, identity, handle, anchor_kind, anchor) of every row; rows of a natural key are one."""
    parts = []
    for name, kind in KINDS.items():
        if kind.table not in tables:
            continue
        text = lambda c: F.col(c).cast("string")
        handle = text(kind.handle) if kind.handle else F.lit(None).cast("string")
        for anchor, column in kind.anchors.items():
            parts.append(
                tables[kind.table].select(
                    F.lit(name).alias("kind"), "org_id", F.concat_ws(":", *map(text, kind.identity)).alias("identity"),
                    handle.alias("handle"), F.lit(anchor).alias("anchor_kind"), text(column).alias("anchor"), F.col(kind.time).alias("at"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def hypotheses(asks: DataFrame) -> DataFrame:
    """One row per question and kind: the pooled kinds and the kind that a handle names.

    ``asks``: question, org_id, handles (array of kind and value), anchor_kind, anchor, pooled
    (array of kinds), current, unscoped.  A kind is keyed if the handle names it or its table
    holds the anchor; the others cannot be eliminated.
    """
    known = F.array(*map(F.lit, KINDS))
    handle = F.when(F.size("handles") == 1, F.col("handles")[0])
    one = asks.withColumn("_handle_kind", handle["kind"]).withColumn("_handle", handle["value"])
    asked = F.array_intersect(F.coalesce("pooled", F.array().cast("array<string>")), known)
    named = F.when(F.array_contains(known, F.col("_handle_kind")), F.array("_handle_kind")).otherwise(F.array().cast("array<string>"))
    each = one.withColumn("kind", F.explode(F.array_union(asked, F.coalesce(named, F.array().cast("array<string>")))))
    anchors = reduce(lambda c, n: c.when(F.col("kind") == n, F.array(*map(F.lit, KINDS[n].anchors))), list(KINDS)[1:], F.when(F.col("kind") == list(KINDS)[0], F.array(*map(F.lit, KINDS[list(KINDS)[0]].anchors))))
    by_handle = F.coalesce(F.col("_handle_kind") == F.col("kind"), F.lit(False))
    by_anchor = F.coalesce(F.array_contains(anchors, F.col("anchor_kind")) & F.col("anchor").isNotNull(), F.lit(False))
    return each.select("question", "org_id", "kind", by_handle.alias("by_handle"), by_anchor.alias("by_anchor"), F.when(by_handle, F.col("_handle")).alias("handle"), F.when(by_anchor, F.col("anchor")).alias("anchor"))


def _on(keys: DataFrame, side: DataFrame, shape: tuple[str, ...]) -> Column:
    return reduce(lambda c, k: c & (keys[k] == side[k]), shape, (keys["kind"] == side["kind"]) & (keys["org_id"] == side["org_id"]))


SHAPES = {("handle",): "by_handle AND NOT by_anchor", ("anchor",): "by_anchor AND NOT by_handle", ("handle", "anchor"): "by_handle AND by_anchor"}


def _satisfied(rows: DataFrame, again: DataFrame, shape: tuple[str, ...]) -> DataFrame:
    """Per key: satisfiers, the identity of one that is alone, and up to ``BUDGET`` + 1 identities of the other reading where there are 1 to ``BUDGET``.

    Rows are counted without their identities, which no hash aggregate can compare; the one
    that is witness is read for keys of one row only, where nothing else is asked of it.
    """
    key = ["kind", "org_id", *shape]
    counts = stored(rows.groupBy(*key).agg(F.count("*").alias("satisfiers")), "counts")
    sole = rows.join(counts.filter("satisfiers = 1").select(*key), key, "left_semi").select(*key, F.col("identity").alias("witness"))
    near = again.join(counts.filter(F.col("satisfiers").between(1, BUDGET)).select(*key), key, "left_semi")
    ids = near.groupBy(*key).agg(F.slice(F.array_sort(F.collect_set("identity")), 1, BUDGET + 1).alias("found"))
    return counts.join(sole, key, "left").join(ids, key, "left")


def attested(asks: DataFrame, rows: DataFrame, again: DataFrame) -> DataFrame:
    """Per question and keyed kind: the count, the satisfiers, and whether both readings agree.

    Of one satisfier the identity read has to be the witness that was counted; of more, the set
    has to be as large as the count.  A set that is not is withheld.
    """
    keyed = stored(hypotheses(asks).filter("by_handle OR by_anchor"), "keyed")
    handle = ["kind", "org_id", "handle"]
    named = stored(keyed.filter("by_handle").select(*handle).distinct(), "named")
    # of rows with a handle only those that someone asks for are counted
    near = [stored(r.join(named, handle, "left_semi"), "near") for r in (rows, again)]
    parts = []
    for shape, which in SHAPES.items():
        asked, met = keyed.filter(which), _satisfied(*(near if "handle" in shape else (rows, again)), shape)
        parts.append(asked.join(met, _on(asked, met, shape), "left").select(asked["question"], asked["kind"], F.coalesce("satisfiers", F.lit(0)).alias("satisfiers"), "witness", "found"))
    out = reduce(DataFrame.unionByName, parts).withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    one, several = F.col("satisfiers") == 1, F.col("satisfiers").between(2, BUDGET)
    swapped = one & ((F.size("found") != 1) | (F.get("found", F.lit(0)) != F.col("witness")))
    open_set = several & (F.size("found") != F.col("satisfiers"))
    return out.select(
        "question", "kind", "satisfiers", F.coalesce(swapped, F.lit(False)).alias("mismatch"), open_set.alias("open_set"),
        F.when(one & ~F.coalesce(swapped, F.lit(True)), F.col("witness")).alias("only"), F.when(several & ~open_set, F.col("found")).alias("satisfier_set"),
    )


def decided(asks: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per question: commit, no_match or clarify, and why.

    A pooled kind outside the census, or one that no key reaches, survives: then neither one
    satisfier nor none proves anything.
    """
    hyp = hypotheses(asks)
    unkeyed = hyp.groupBy("question").agg(F.bool_or(~(F.col("by_handle") | F.col("by_anchor"))).alias("_unkeyed"), F.count("*").alias("_asked"))
    sums = kinds.groupBy("question").agg(
        F.bool_or("mismatch").alias("_mismatch"), F.count("*").alias("censused"),
        F.count_if((F.col("satisfiers") == 1) & ~F.col("mismatch")).alias("_ones"), F.count_if(F.col("satisfiers") > 1).alias("_many"),
        F.max(F.when(~F.col("mismatch"), F.col("only"))).alias("_only"),
    )
    out = asks.join(unkeyed, "question", "left").join(sums, "question", "left")
    known = F.array(*map(F.lit, KINDS))
    outside = F.size(F.array_except(F.coalesce("pooled", F.array().cast("array<string>")), known)) > 0
    survivor = F.coalesce(outside | F.coalesce("_unkeyed", F.lit(False)), F.lit(False))
    n_handles = F.size(F.coalesce("handles", F.array().cast("array<struct<kind:string,value:string>>")))
    no_anchor = F.col("anchor_kind").isNull() | F.col("anchor").isNull()
    reason = (
        F.when(~F.col("current"), HISTORICAL)
        .when(~F.col("unscoped"), SCOPED)
        .when(n_handles > 1, MULTI_HANDLE)
        .when((n_handles == 0) & no_anchor, NO_DISCRIMINATORS)
        .when((n_handles == 1) & ~F.array_contains(known, F.col("handles")[0]["kind"]), UNREGISTERED)
        .when(F.coalesce("censused", F.lit(0)) == 0, NO_DISCRIMINATORS)
        .when(F.col("_mismatch"), MISMATCH)
    )
    ones, many = F.coalesce("_ones", F.lit(0)), F.coalesce("_many", F.lit(0))
    outcome = F.when(reason.isNotNull(), "clarify").when((ones == 1) & (many == 0) & ~survivor, "commit").when((ones == 0) & (many == 0) & ~survivor, "no_match").otherwise("clarify")
    return out.select(
        "question", outcome.alias("outcome"), reason.alias("reason"), survivor.alias("survivor"),
        F.when(reason.isNull() | (reason == MISMATCH), F.col("censused")).otherwise(F.lit(0)).cast("long").alias("censused"), F.when(outcome == "commit", F.col("_only")).alias("only"),
    )


def cardinality(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a kind and organization within each asked window: question, kind, org_id, start, end, as_of.

    Both ends count; ``as_of`` bounds from above only where neither start nor end is given, and
    without any bound all rows count.  Rows are counted per time before they meet the windows.
    """
    times = rows.groupBy("kind", "org_id", "at").count().withColumnsRenamed({"kind": "_kind", "org_id": "_org"})
    upper = F.coalesce("end", F.when(F.col("start").isNull(), F.col("as_of")))
    bound = asks.select("question", "kind", "org_id", F.col("start").alias("_low"), upper.alias("_high"))
    # a row without a time is in no window, but counts where there is none
    low = F.col("_low").isNull() | F.coalesce(F.col("at") >= F.col("_low"), F.lit(False))
    high = F.col("_high").isNull() | F.coalesce(F.col("at") <= F.col("_high"), F.lit(False))
    # times meet windows, not windows times: what an organization's rows are joined to are the few that ask for it
    inside = times.join(bound, (F.col("kind") == F.col("_kind")) & (F.col("org_id") == F.col("_org")) & low & high)
    key = ["question", "kind", "org_id"]
    sums = inside.groupBy(*key).agg(F.sum("count").alias("rows"))
    return asks.select(*key).distinct().join(sums, key, "left").select(*key, F.coalesce("rows", F.lit(0)).alias("rows"))
