"""The evidence catalog: seventeen sources in one ten-column shape."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_label, safe_uri
from ..functions.vocabulary import ARTIFACT_PROVENANCE, DEPLOYMENT_PROVENANCE, INCIDENT_PROVENANCE, REVIEW_PROVENANCE, choose, clamp
from ..operators.temporal import as_of, stamp, trailing, valid_at
from ..operators.versions import first_per_key, latest_snapshot, latest_version

COLUMNS = ("evidence_ref_id", "system", "entity_type", "entity_id", "display_label", "safe_uri", "provenance", "confidence", "citation", "observed_at")
SYSTEM = "telemetry"


@dataclass(frozen=True)
class Request:
    """What a packet asks for; empty fields filter nothing."""

    org_id: str
    repo_id: str
    repo_slug: str = ""
    branch: str = ""
    commit_sha: str = ""
    task_ref: str = ""
    files: tuple[str, ...] = ()
    as_of: dt.datetime | None = None
    time_window_days: int = 0
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


Tables = dict[str, DataFrame]
L = F.lit
text = lambda c: F.coalesce(F.col(c), L(""))


def _shape(df: DataFrame, prefix: str, kind: Column | str, entity: Column, label: Column, citation: Column, observed: Column, uri: Column | None = None, provenance: Column | None = None, confidence: Column | None = None) -> DataFrame:
    values = (
        F.concat(L(f"{prefix}:"), entity), L(SYSTEM), L(kind) if isinstance(kind, str) else kind, entity, label, uri if uri is not None else L(""),
        provenance if provenance is not None else L("native"), (confidence if confidence is not None else L(1.0)).cast("double"), citation, observed,
    )
    return df.select(*[v.alias(n) for n, v in zip(COLUMNS, values, strict=True)])


def _repo(df: DataFrame, r: Request, org: bool = False) -> DataFrame:
    df = df.filter(F.col("repo_id") == r.repo_id)
    return df.filter(F.col("org_id") == r.org_id) if org else df


def _of_repo(df: DataFrame, t: Tables, r: Request) -> DataFrame:
    """Rows of the repository, if the organization owns it: the one row of repos is a semi join."""
    repos = t["repos"].filter((F.col("org_id") == r.org_id) & (F.col("id") == r.repo_id)).select(F.col("id").alias("repo_id"))
    return _repo(df, r).join(repos, "repo_id", "left_semi")


def _time(df: DataFrame, observed: Column, r: Request, windowed: bool = True) -> DataFrame:
    df = as_of(df, observed, r.as_of)
    return trailing(df, observed, r.time_window_days, r.as_of, r.now) if windowed else df


def repository_freshness(t: Tables, r: Request) -> DataFrame:
    df = t["repos"].filter((F.col("org_id") == r.org_id) & (F.col("id") == r.repo_id))
    if r.repo_slug:
        df = df.filter(F.col("repo") == r.repo_slug)
    if r.branch:
        df = df.filter(F.col("ref") == r.branch)
    df = as_of(df, "last_synced", r.as_of)
    return _shape(df, "repository", "repository", F.col("id"), bounded_label(text("repo"), F.concat(L("repository "), "id")), L("repository freshness"), F.col("last_synced"))


def _items(t: Tables, r: Request) -> DataFrame:
    """The newest version of each item that lies in the repository; items that never were there are not sorted."""
    ever = _repo(t["work_items"], r, org=True).select("work_item_id")
    return _repo(latest_version(t["work_items"].join(ever, "work_item_id", "left_semi"), ["work_item_id"], "last_synced"), r, org=True)


def work_items(t: Tables, r: Request) -> DataFrame:
    df = _time(_items(t, r), F.col("updated_at"), r)
    if r.task_ref:
        df = df.filter(F.col("work_item_id") == r.task_ref)
    name = F.col("work_item_id")
    return _shape(df, "work-item", "work_item", name, bounded_label(text("title"), F.concat(L("work item "), name)), bounded_label(text("status"), F.concat(L("work_item_id="), name), 2000), F.col("updated_at"), safe_uri(text("url")))


def work_item_dependencies(t: Tables, r: Request) -> DataFrame:
    d = as_of(t["work_item_dependencies"].filter(F.col("org_id") == r.org_id), "last_synced", r.as_of)
    if r.task_ref:
        d = d.filter((F.col("source_work_item_id") == r.task_ref) | (F.col("target_work_item_id") == r.task_ref))
    mine = _items(t, r).select(F.col("work_item_id").alias("source_work_item_id"))
    d = d.join(mine, "source_work_item_id", "left_semi")
    pair = F.concat("source_work_item_id", L(":"), "target_work_item_id")
    return _shape(d, "work-item-dependency", "work_item_dependency", pair, F.concat_ws(" ", "source_work_item_id", "relationship_type", "target_work_item_id"), bounded_label(F.col("relationship_type"), F.concat(L("dependency="), pair), 2000), F.col("last_synced"))


def git_commits(t: Tables, r: Request) -> DataFrame:
    df = _time(_of_repo(t["git_commits"], t, r), F.col("committer_when"), r)
    if r.commit_sha:
        df = df.filter(F.col("hash") == r.commit_sha)
    named = F.concat(L("commit "), "hash")
    return _shape(df, "commit", "commit", F.col("hash"), bounded_label(text("message"), named), bounded_label(text("message"), named, 2000), F.col("committer_when"))


def git_commit_files(t: Tables, r: Request) -> DataFrame:
    df = as_of(_of_repo(t["git_commit_stats"], t, r), "last_synced", r.as_of)
    if r.commit_sha:
        df = df.filter(F.col("commit_hash") == r.commit_sha)
    if r.files:
        df = df.filter(F.col("file_path").isin(*r.files))
    citation = F.concat(F.col("additions").cast("string"), L(" additions, "), F.col("deletions").cast("string"), L(" deletions"))
    return _shape(df, "commit-file", "commit_file", F.concat("commit_hash", L(":"), "file_path"), bounded_label(text("file_path"), F.concat(L("commit file "), "commit_hash")), citation, F.col("last_synced"))


def _branch(df: DataFrame, r: Request) -> DataFrame:
    return df.filter((F.col("head_branch") == r.branch) | (F.col("base_branch") == r.branch)) if r.branch else df


def pull_requests(t: Tables, r: Request) -> DataFrame:
    df = _branch(_time(_of_repo(t["git_pull_requests"], t, r), F.col("last_synced"), r), r)
    number = F.col("number").cast("string")
    named = F.concat(L("PR #"), number)
    return _shape(df, "pull-request", "pull_request", number, bounded_label(text("title"), named), bounded_label(text("state"), named, 2000), F.col("last_synced"))


def pull_request_reviews(t: Tables, r: Request) -> DataFrame:
    df = _time(_of_repo(t["git_pull_request_reviews"], t, r), F.col("submitted_at"), r)
    df = df.join(_branch(_repo(t["git_pull_requests"], r), r).select("repo_id", "number"), ["repo_id", "number"], "left_semi")
    return _shape(df, "review", "pull_request_review", F.col("review_id"), F.concat(L("PR #"), F.col("number").cast("string"), L(" review")), bounded_label(text("state"), F.concat(L("review_id="), "review_id"), 2000), F.col("submitted_at"))


def ci_pipeline_runs(t: Tables, r: Request) -> DataFrame:
    df = _time(_of_repo(t["ci_pipeline_runs"], t, r), F.col("started_at"), r)
    if r.branch:
        df = df.filter(F.col("branch") == r.branch)
    return _shape(df, "ci", "ci_pipeline_run", F.col("run_id"), F.concat(L("CI "), "run_id"), bounded_label(text("status"), F.concat(L("run_id="), "run_id"), 2000), F.coalesce("finished_at", "started_at"))


def work_graph(t: Tables, r: Request) -> DataFrame:
    df = as_of(_repo(t["work_graph_edges"], r), "discovered_at", r.as_of)
    for ref in filter(None, (r.task_ref, r.commit_sha)):
        df = df.filter((F.col("source_id") == ref) | (F.col("target_id") == ref))
    return _shape(df, "graph", "work_graph_edge", F.col("edge_id"), F.concat_ws(" ", "source_id", "edge_type", "target_id"), F.concat(L("edge_id="), "edge_id"), F.col("discovered_at"), None, F.col("provenance"), F.col("confidence"))


def ai_workflow_runs(t: Tables, r: Request) -> DataFrame:
    df = _time(_repo(t["ai_workflow_runs"], r), F.col("observed_at"), r)
    joined = F.concat(text("provider"), L(" "), text("run_kind"), L(" "), text("status"))
    label = F.when(F.char_length(F.trim(joined)).between(1, 1000), joined).otherwise(F.concat(L("AI workflow "), "run_id"))
    return _shape(df, "ai-run", "ai_workflow_run", F.col("run_id"), label, bounded_label(text("status"), F.concat(L("run_id="), "run_id"), 2000), F.col("observed_at"))


def ai_workflow_artifacts(t: Tables, r: Request) -> DataFrame:
    df = as_of(_repo(t["ai_workflow_artifacts"], r), "observed_at", r.as_of)
    return _shape(df, "ai-artifact", F.col("artifact_type"), F.col("artifact_id"), F.concat(L("AI artifact "), "artifact_id"), F.concat(L("artifact_id="), "artifact_id"), F.col("observed_at"), None, choose(F.col("source"), ARTIFACT_PROVENANCE), F.col("confidence"))


def ai_review_outcomes(t: Tables, r: Request) -> DataFrame:
    df = as_of(_repo(t["ai_review_outcomes"], r), "observed_at", r.as_of)
    return _shape(df, "review-outcome", "review_outcome", F.col("review_outcome_id"), F.concat(L("PR "), F.col("pr_id").cast("string"), L(" review outcome")), bounded_label(text("outcome"), F.concat(L("review_outcome_id="), "review_outcome_id"), 2000), F.col("observed_at"), None, choose(F.col("source"), REVIEW_PROVENANCE), F.col("confidence"))


def deployments(t: Tables, r: Request) -> DataFrame:
    observed = F.coalesce("deployed_at", "started_at", "last_synced")
    df = as_of(_of_repo(t["deployments"], t, r), observed, r.as_of)
    label = F.when(F.char_length(text("environment")).between(1, 1000), F.concat("environment", L(" deployment"))).otherwise(F.concat(L("deployment "), "deployment_id"))
    citation = F.when(F.col("release_ref") != "", F.concat(L("release_ref="), "release_ref")).otherwise(F.concat(L("deployment_id="), "deployment_id"))
    return _shape(df, "deployment", "deployment", F.col("deployment_id"), label, citation, observed, None, None, F.col("release_ref_confidence"))


def incidents(t: Tables, r: Request) -> DataFrame:
    """Incidents of services mapped to the repository at the time asked for; the surest mapping decides."""
    at = stamp(r.as_of or r.now)
    m = _repo(t["service_mappings"], r, org=True).filter((F.col("is_active") == 1) & valid_at(F.col("valid_from"), F.col("valid_to"), at))
    m = m.select("org_id", "service_id", F.col("id").alias("mapping_id"), "relationship_provenance", "relationship_confidence")
    i = t["operational_incidents"].filter((F.col("org_id") == r.org_id) & (F.col("is_deleted") == 0))
    observed = F.coalesce("started_at", "observed_at")
    surest = [F.desc_nulls_last("relationship_confidence"), F.col("mapping_id")]
    # of a service's mappings only the surest can decide, so an incident meets one and not all of them
    df = _time(i, observed, r).join(first_per_key(m, ["org_id", "service_id"], surest), ["org_id", "service_id"])
    df = first_per_key(df, ["id"], surest)
    citation = F.concat(L("status="), text("normalized_status"), L(", severity="), text("normalized_severity"))
    return _shape(df, "incident", "incident", F.col("id"), F.col("title"), citation, observed, None, choose(F.col("relationship_provenance"), INCIDENT_PROVENANCE), clamp(F.coalesce("relationship_confidence", L(1.0))))


def deployment_incidents(t: Tables, r: Request) -> DataFrame:
    df = as_of(_repo(t["deployment_incident_edges"], r), "observed_at", r.as_of)
    return _shape(df, "deployment-incident", "deployment_incident_edge", F.col("edge_id"), F.concat("deployment_id", L(" linked to "), "incident_id"), F.concat(L("edge_id="), "edge_id"), F.col("observed_at"), None, choose(F.col("source"), DEPLOYMENT_PROVENANCE), F.col("confidence"))


def file_hotspots(t: Tables, r: Request) -> DataFrame:
    """Only the latest run on or before the time; files that it lacks are gone."""
    df = as_of(_repo(t["file_hotspot_daily"], r), F.col("day").cast("timestamp_ntz"), r.as_of)
    df = latest_snapshot(df, ["repo_id"], [F.desc("day"), F.desc("computed_at")], ["day", "computed_at"])
    if r.files:
        df = df.filter(F.col("file_path").isin(*r.files))
    citation = F.concat(L("churn="), F.col("churn_loc_30d").cast("string"), L(", complexity="), F.col("cyclomatic_total").cast("string"))
    return _shape(df, "hotspot", "file_hotspot", F.col("file_path"), F.col("file_path"), citation, F.col("day").cast("timestamp_ntz"))


def file_complexity(t: Tables, r: Request) -> DataFrame:
    """The latest snapshot; of refs equally new the least name decides."""
    df = as_of(_repo(t["file_complexity_snapshots"], r), F.col("as_of_day").cast("timestamp_ntz"), r.as_of)
    if r.branch:
        df = df.filter(F.col("ref") == r.branch)
    df = latest_snapshot(df, ["repo_id"], [F.desc("as_of_day"), F.desc("computed_at"), F.col("ref")], ["ref", "as_of_day", "computed_at"])
    if r.files:
        df = df.filter(F.col("file_path").isin(*r.files))
    return _shape(df, "complexity", "file_complexity", F.col("file_path"), F.col("file_path"), F.concat(L("complexity="), F.col("cyclomatic_total").cast("string")), F.col("as_of_day").cast("timestamp_ntz"))


#: name: (function, tables it reads, whether branch or commit narrow it)
CATALOG: dict[str, tuple[Callable[[Tables, Request], DataFrame], tuple[str, ...], bool]] = {
    "repository_freshness": (repository_freshness, ("repos",), True),
    "work_items": (work_items, ("work_items",), False),
    "work_item_dependencies": (work_item_dependencies, ("work_item_dependencies", "work_items"), False),
    "git_commits": (git_commits, ("git_commits", "repos"), True),
    "git_commit_files": (git_commit_files, ("git_commit_stats", "repos"), True),
    "pull_requests": (pull_requests, ("git_pull_requests", "repos"), True),
    "pull_request_reviews": (pull_request_reviews, ("git_pull_request_reviews", "git_pull_requests", "repos"), True),
    "ci_pipeline_runs": (ci_pipeline_runs, ("ci_pipeline_runs", "repos"), True),
    "work_graph": (work_graph, ("work_graph_edges",), False),
    "ai_workflow_runs": (ai_workflow_runs, ("ai_workflow_runs",), False),
    "ai_workflow_artifacts": (ai_workflow_artifacts, ("ai_workflow_artifacts",), False),
    "ai_review_outcomes": (ai_review_outcomes, ("ai_review_outcomes",), False),
    "deployments": (deployments, ("deployments", "repos"), False),
    "incidents": (incidents, ("operational_incidents", "service_mappings"), False),
    "deployment_incidents": (deployment_incidents, ("deployment_incident_edges",), False),
    "file_hotspots": (file_hotspots, ("file_hotspot_daily",), False),
    "file_complexity": (file_complexity, ("file_complexity_snapshots",), True),
}


def catalog_sources(tables: Tables, request: Request) -> tuple[dict[str, Callable[[], DataFrame]], dict[str, str]]:
    """How each source whose tables are there is read, with source and scope in its rows; what is
    missing is reported as unavailable and does not stop the others."""
    found: dict[str, Callable[[], DataFrame]] = {}
    unavailable = {}
    for name, (source, needs, narrowed) in CATALOG.items():
        if missing := [n for n in needs if n not in tables]:
            unavailable[name] = f"no table {', '.join(missing)}"
            continue
        scope = "narrowed" if narrowed and (request.branch or request.commit_sha) else "repository"
        found[name] = partial(lambda f, n, s: f(tables, request).withColumns({"source": L(n), "scope": L(s)}), source, name, scope)
    return found, unavailable


def run_catalog(tables: Tables, request: Request, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources in one frame, in order.  ``each`` is applied to a source's rows before they are united."""
    found, unavailable = catalog_sources(tables, request)
    parts = [each(read()) for read in found.values()]
    return (reduce(DataFrame.unionByName, parts) if parts else None), unavailable
