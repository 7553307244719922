"""From handles back to evidence, and from requests to the repository they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a source that one handle without a locator may list, and why a scope fell back.
LISTED = 500
DEFAULT_BRANCH, WHOLE_REPOSITORY, NOT_FOUND = "repository_default_branch_fallback", "repo_wide_evidence", "authorized_repository_not_found"


def resolve_handles(evidence: DataFrame, handles: DataFrame, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """What many handles refer to: (handle, state, matches) of each, and (handle, evidence_ref_id) of those found.

    evidence: source, repo_id, evidence_ref_id; handles: handle, source, repo_id, locator, the
    last a hash of an evidence id or null for all of a source.  Ids are hashed once, whatever the
    number of handles.  A locator that two rows answer to is refused, as is a list of more than
    ``listed`` rows; both are ``saturated`` and say how many rows there were.  Rows of a source
    are counted before they are joined, so a refused list costs one row.
    """
    key = ["source", "repo_id"]
    hashed = evidence.select(*key, "evidence_ref_id", F.sha2("evidence_ref_id", 256).alias("locator"))
    per_locator = hashed.groupBy(*key, "locator").agg(F.count("*").alias("_n"), F.min("evidence_ref_id").alias("evidence_ref_id"))
    per_source = evidence.groupBy(*key).agg(F.count("*").alias("_n"))
    located = handles.filter(F.length("locator") == 64).join(per_locator, [*key, "locator"], "left")
    listing = handles.filter("locator IS NULL").join(per_source, key, "left")
    invalid = handles.filter("length(locator) <> 64")
    n = F.coalesce("_n", F.lit(0))
    state = lambda most: F.when(n == 0, "not_found").when(n > most, "saturated").otherwise("found")
    states = located.select("handle", state(1).alias("state"), n.alias("matches")).unionByName(listing.select("handle", state(listed).alias("state"), n.alias("matches")))
    states = states.unionByName(invalid.select("handle", F.lit("invalid").alias("state"), F.lit(0).cast("long").alias("matches")))
    found = located.filter("_n = 1").select("handle", "evidence_ref_id")
    whole = listing.filter(F.col("_n") <= listed).select("handle", *key).join(evidence, key).select("handle", "evidence_ref_id")
    return states, found.unionByName(whole)


def resolve_scopes(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each request's repository and how far its evidence is narrowed.

    requests: request, org_id, slug, branch, commit_sha (empty or null: not given);
    repositories: org_id, repo_id, slug, branch.  Two repositories of one slug are ambiguous,
    none leaves the request unresolved.
    """
    named = repositories.groupBy("org_id", "slug").agg(F.count_distinct("repo_id").alias("_n"), F.min("repo_id").alias("repo_id"), F.min(F.nullif("branch", F.lit(""))).alias("_default"))
    out = requests.join(named, ["org_id", "slug"], "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    resolution = (
        F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").when(given("commit_sha"), "exact_commit").when(given("branch"), "branch_filtered").otherwise("repo_fallback")
    )
    fallback = F.when(resolution == "unresolved", NOT_FOUND).when(resolution == "repo_fallback", F.when(F.col("_default").isNotNull(), DEFAULT_BRANCH).otherwise(WHOLE_REPOSITORY))
    branch = F.when((resolution == "repo_fallback") & F.col("_default").isNotNull(), F.col("_default")).otherwise(F.nullif("branch", F.lit("")))
    return out.select("request", resolution.alias("resolution"), F.when(F.col("_n") == 1, F.col("repo_id")).alias("repo_id"), branch.alias("branch"), fallback.alias("fallback"))


def survivors_first(candidates: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidates in their order, those that a census has ruled out last.

    candidates: question, place, kind, node_id; kinds: question, kind, only, satisfiers, mismatch, as
    a census attests them.  A kind of no satisfier rules all its candidates out, one of exactly
    one rules out the others; a kind with a mismatch or several rules out none.
    """
    known = kinds.select(F.col("question").alias("_question"), F.col("kind").alias("_kind"), "only", "satisfiers", "mismatch")
    # joined by the question alone, which has few kinds, so that candidates stay where their question is ranked
    met = candidates.join(known, (F.col("question") == F.col("_question")) & F.array_contains(F.array("_kind"), F.col("kind")), "left")
    out = F.coalesce(~F.col("mismatch") & ((F.col("satisfiers") == 0) | ((F.col("satisfiers") == 1) & (F.col("only") != F.col("node_id")))), F.lit(False))
    order = Window.partitionBy("question").orderBy("_out", "place")  # a question's candidates, a bounded list
    return met.withColumn("_out", out).withColumn("rank", F.row_number().over(order)).select("question", "rank", "kind", "node_id", F.col("_out").alias("ruled_out"))
