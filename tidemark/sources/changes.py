"""Change producers: source rows become entities, edges and tombstones of the graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import derive_id, derive_relationship
from ..operators.temporal import intersect_validity
from ..operators.versions import fold_ownership, latest_version, unambiguous

Tables = dict[str, DataFrame]

#: Relation types that may be stored.
RELATIONS = ("BELONGS_TO_REPOSITORY", "BELONGS_TO_PULL_REQUEST", "BELONGS_TO_PROJECT", "ATTRIBUTED_TO_TEAM", "OWNED_BY_TEAM", "PART_OF", "BLOCKS", "DEPENDS_ON", "CAUSED")

CHANGE = "op string, kind string, node_id string, label string, source_id string, target_id string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz"


def nothing() -> Column:
    return F.lit(None).cast("string")


def no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _node(kind: str, key: Column, label: Column, observed: Column, valid_from: Column | None = None, valid_to: Column | None = None, op: Column | str = "node") -> Column:
    """A node upsert, or with another op its tombstone."""
    values = (F.lit(op) if isinstance(op, str) else op, F.lit(kind), derive_id(kind, key), label, nothing(), nothing(), nothing(), valid_from if valid_from is not None else no_time(), valid_to if valid_to is not None else no_time(), observed)
    return F.struct(*[v.alias(n.split()[0]) for v, n in zip(values, CHANGE.split(", "), strict=True)])


def _edge(relation: str | Column, source: Column, target: Column, observed: Column, valid_from: Column | None = None, valid_to: Column | None = None, op: Column | str = "edge") -> Column:
    values = (F.lit(op) if isinstance(op, str) else op, F.lit("relationship"), derive_relationship(F.lower(F.lit(relation)), source, target), nothing(), source, target, F.lit(relation), valid_from if valid_from is not None else no_time(), valid_to if valid_to is not None else no_time(), observed)
    return F.struct(*[v.alias(n.split()[0]) for v, n in zip(values, CHANGE.split(", "), strict=True)])


def _emit(df: DataFrame, *changes: Column) -> DataFrame:
    """One row per change that is not null."""
    return df.select(F.explode(F.array_compact(F.array(*changes))).alias("_c")).select("_c.*")


def _repo_of(df: DataFrame, t: Tables) -> DataFrame:
    """Left join with the repositories: ``known`` is null where the repository is not there."""
    return df.join(t["repos"].select(F.col("id").alias("repo_id"), F.lit(True).alias("known")), "repo_id", "left")


def _in_repo(df: DataFrame, kind: str, key: Column, observed: Column, label: Column, valid_from: Column | None = None, valid_to: Column | None = None) -> DataFrame:
    edge = F.when(F.col("known"), _edge("BELONGS_TO_REPOSITORY", derive_id(kind, key), derive_id("repository", F.col("repo_id")), observed, valid_from, valid_to))
    return _emit(df, _node(kind, key, label, observed, valid_from, valid_to), edge)


def organization_seed(t: Tables) -> DataFrame:
    """One anchor per organization, a second after the epoch, so that everything else is later."""
    orgs = t["repos"].select("org_id").distinct()
    return _emit(orgs, _node("organization", F.col("org_id"), F.col("org_id"), F.lit("1970-01-01 00:00:01").cast("timestamp_ntz")))


def repositories(t: Tables) -> DataFrame:
    """Label: the full name; the bare name after the last slash is an alias (see aliases)."""
    return _emit(t["repos"], _node("repository", F.col("id"), F.col("repo"), F.col("last_synced")))


def repository_aliases(t: Tables) -> DataFrame:
    names = F.array_distinct(F.array(F.col("repo"), F.element_at(F.split("repo", "/"), -1), F.concat("provider", F.lit(":"), "repo")))
    return t["repos"].select(derive_id("repository", F.col("id")).alias("node_id"), F.explode(names).alias("alias"))


def work_items(t: Tables) -> DataFrame:
    df = _repo_of(latest_version(t["work_items"], ["work_item_id"], "last_synced"), t)
    return _in_repo(df, "work_item", F.col("work_item_id"), F.col("last_synced"), F.col("title"), F.col("created_at"), F.col("completed_at"))


def pull_requests(t: Tables) -> DataFrame:
    key = F.concat("repo_id", F.lit("#"), F.col("number").cast("string"))
    return _in_repo(_repo_of(t["git_pull_requests"], t).filter("known"), "pull_request", key, F.col("last_synced"), F.col("title"), F.col("created_at"), F.coalesce("merged_at", "closed_at"))


def pull_request_reviews(t: Tables) -> DataFrame:
    pulls = t["git_pull_requests"].select("repo_id", "number")
    df = t["git_pull_request_reviews"].join(pulls, ["repo_id", "number"], "left_semi")
    pull = derive_id("pull_request", F.concat("repo_id", F.lit("#"), F.col("number").cast("string")))
    return _emit(df, _node("review", F.col("review_id"), F.col("state"), F.col("submitted_at")), _edge("BELONGS_TO_PULL_REQUEST", derive_id("review", F.col("review_id")), pull, F.col("submitted_at")))


def deployments(t: Tables) -> DataFrame:
    key = F.concat("repo_id", F.lit("#"), "deployment_id")
    return _in_repo(_repo_of(t["deployments"], t).filter("known"), "deployment", key, F.col("last_synced"), F.col("deployment_id"), F.col("started_at"), F.col("finished_at"))


def ci_runs(t: Tables) -> DataFrame:
    return _in_repo(_repo_of(t["ci_pipeline_runs"], t).filter("known"), "ci_run", F.col("run_id"), F.coalesce("finished_at", "started_at"), F.col("run_id"), F.col("started_at"), F.col("finished_at"))


def incidents(t: Tables) -> DataFrame:
    """A deleted incident becomes a tombstone."""
    gone = F.when(F.col("is_deleted") == 1, "node_tombstone").otherwise("node")
    return _emit(t["operational_incidents"], _node("incident", F.col("id"), F.col("title"), F.col("observed_at"), F.col("started_at"), F.col("resolved_at"), gone))


def dependencies(t: Tables) -> DataFrame:
    """A resolved edge and the tombstones that heal its stub, or a stub with an edge to it.

    Rows move twice: to their source, where their versions are made one, and with the source's
    times to their target, where the first row of each target also heals its stub.
    """
    # times have fixed width, so the newest of an item is found by hash; a null version counts least
    version = F.coalesce("last_synced", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    items = t["work_items"].groupBy("work_item_id").agg(*[F.max_by(c, version).alias(c) for c in ("created_at", "completed_at")])
    keys = ["source_work_item_id", "target_work_item_id", "relationship_type"]
    d = t["work_item_dependencies"].filter("relationship_type IS NOT NULL").select(*keys, "last_synced").repartition("source_work_item_id")
    d = d.groupBy(*keys).agg(F.max("last_synced").alias("last_synced"))
    ends = lambda side: items.select(F.col("work_item_id").alias(f"{side}_work_item_id"), F.col("created_at").alias(f"{side}_from"), F.col("completed_at").alias(f"{side}_to"), F.lit(True).alias(f"{side}_there"))
    df = d.join(ends("source"), "source_work_item_id").select(*keys[:2], (F.lower("relationship_type") == "blocks").alias("_blocks"), "last_synced", "source_from", "source_to")
    # many dependencies heal one stub: one tombstone is enough, that of the newest; the join finds its rows sorted
    nth = F.row_number().over(Window.partitionBy("target_work_item_id").orderBy(F.desc_nulls_last("last_synced")))
    df = df.withColumn("_nth", nth).join(ends("target"), "target_work_item_id", "left")
    # ids and relation are columns of the joined rows, so each is derived once and both relations come from one reading
    made = [derive_id(k, F.col(f"{c}_work_item_id")).alias(n) for n, k, c in (("_source", "work_item", "source"), ("_target", "work_item", "target"), ("_stub", "work_item_ref", "target"))]
    df = df.select("*", *made, F.when(F.col("_blocks"), "BLOCKS").otherwise("DEPENDS_ON").alias("_relation"))
    source, target, stub, relation = map(F.col, ("_source", "_target", "_stub", "_relation"))
    start, end = intersect_validity((F.col("source_from"), F.col("source_to")), (F.col("target_from"), F.col("target_to")))
    at, there = F.col("last_synced"), F.col("target_there").isNotNull()
    found = [_edge(relation, source, target, at, start, end), _edge(relation, source, stub, at, op="edge_tombstone")]
    healed = F.when(F.col("_nth") == 1, _node("work_item_ref", F.col("target_work_item_id"), nothing(), at, op="orphan_tombstone"))
    absent = F.array(_node("work_item_ref", F.col("target_work_item_id"), F.col("target_work_item_id"), at), _edge(relation, source, stub, at))
    return df.select(F.explode(F.when(there, F.array(*found, healed)).otherwise(absent)).alias("_c")).filter("_c IS NOT NULL").select("_c.*")


def hierarchy(t: Tables) -> DataFrame:
    items = latest_version(t["work_items"], ["work_item_id"], "last_synced").select("work_item_id", "parent_id", "created_at", "completed_at", "last_synced")
    parents = items.select(F.col("work_item_id").alias("parent_id"), F.col("created_at").alias("p_from"), F.col("completed_at").alias("p_to"))
    df = items.filter("work_item_id <> parent_id").join(parents, "parent_id")
    start, end = intersect_validity((F.col("created_at"), F.col("completed_at")), (F.col("p_from"), F.col("p_to")))
    return _emit(df, _edge("PART_OF", derive_id("work_item", F.col("work_item_id")), derive_id("work_item", F.col("parent_id")), F.col("last_synced"), start, end))


def deployment_incidents(t: Tables) -> DataFrame:
    """Edges with both ids; ids repeat across repositories, so the repository joins too."""
    e = t["deployment_incident_edges"].filter("incident_id NOT IN ('', 'none') AND deployment_id <> ''")
    d = t["deployments"].groupBy("repo_id", "deployment_id").agg(F.min("started_at").alias("d_from"))
    i = t["operational_incidents"].select(F.col("id").alias("incident_id"), F.col("started_at").alias("i_from"), F.col("resolved_at").alias("i_to"))
    df = e.join(d, ["repo_id", "deployment_id"], "left").join(i, "incident_id", "left")
    start, end = intersect_validity((F.col("d_from"), no_time()), (F.col("i_from"), F.col("i_to")))
    return _emit(df, _edge("CAUSED", derive_id("deployment", F.concat("repo_id", F.lit("#"), "deployment_id")), derive_id("incident", F.col("incident_id")), F.col("observed_at"), start, end))


def teams(t: Tables) -> DataFrame:
    df = t["team_project_ownership"].groupBy("team_id").agg(F.max("valid_from").alias("at"))
    return _emit(df, _node("team", F.col("team_id"), F.col("team_id"), F.col("at")))


def projects(t: Tables) -> DataFrame:
    df = t["team_project_ownership"].groupBy("org_id", "project_key").agg(F.max("valid_from").alias("at"))
    return _emit(df, _node("project", F.concat("org_id", F.lit("/"), "project_key"), F.col("project_key"), F.col("at")))


def work_item_projects(t: Tables) -> DataFrame:
    df = latest_version(t["work_items"], ["work_item_id"], "last_synced").filter("project_id IS NOT NULL")
    return _emit(df, _edge("BELONGS_TO_PROJECT", derive_id("work_item", F.col("work_item_id")), derive_id("project", F.concat("org_id", F.lit("/"), "project_id")), F.col("last_synced")))


def project_teams(t: Tables) -> DataFrame:
    """Folded ownership windows of projects that one organization claims alone."""
    o = t["team_project_ownership"]
    single, _ = unambiguous(o.select("provider", "project_key", "org_id").distinct(), ["provider", "project_key"])
    folded = fold_ownership(o.join(single, ["provider", "project_key", "org_id"], "left_semi"), ["org_id", "project_key", "team_id"], "valid_from", "valid_to")
    return _emit(folded, _edge("OWNED_BY_TEAM", derive_id("project", F.concat("org_id", F.lit("/"), "project_key")), derive_id("team", F.col("team_id")), F.col("valid_from"), F.col("valid_from"), F.col("valid_to")))


def incident_repositories(t: Tables) -> DataFrame:
    """An edge from each incident that is not deleted to every repository its service actively maps to."""
    maps = t["service_mappings"].filter("is_active = 1").select("org_id", "service_id", "repo_id").distinct()
    repos = t["repos"].select(F.col("id").alias("repo_id"), "org_id")
    df = t["operational_incidents"].filter("is_deleted = 0").join(maps, ["org_id", "service_id"]).join(repos, ["repo_id", "org_id"], "left_semi")
    at = F.coalesce("started_at", "observed_at")
    return _emit(df, _edge("BELONGS_TO_REPOSITORY", derive_id("incident", F.col("id")), derive_id("repository", F.col("repo_id")), at, F.col("started_at"), F.col("resolved_at")))


def work_item_teams(t: Tables) -> DataFrame:
    """The primary attribution of an item that is there to a team that is there."""
    items, teams = t["work_items"].select("work_item_id"), t["team_project_ownership"].select("team_id")
    a = latest_version(t["work_item_team_attributions"], ["work_item_id", "team_id"], "computed_at", ["is_primary"])
    df = a.filter("is_primary = 1 AND team_id <> ''").join(items, "work_item_id", "left_semi").join(teams, "team_id", "left_semi")
    return _emit(df, _edge("OWNED_BY_TEAM", derive_id("work_item", F.col("work_item_id")), derive_id("team", F.col("team_id")), F.col("computed_at")))


def resolved_projects(t: Tables) -> DataFrame:
    """The project of an item, by provider, where one provider alone has its id."""
    single, _ = unambiguous(t["projects"], ["id"])
    items = latest_version(t["work_items"], ["work_item_id"], "last_synced").select("work_item_id", F.col("project_id").alias("id"), "updated_at")
    return _emit(items.join(single, "id"), _edge("BELONGS_TO_PROJECT", derive_id("work_item", F.col("work_item_id")), derive_id("project", F.col("provider"), F.col("id")), F.col("updated_at")))


def omitted_projects(t: Tables) -> DataFrame:
    """The ledger of what ``resolved_projects`` leaves out: ambiguous ids, their claimants and items."""
    _, several = unambiguous(t["projects"], ["id"])
    items = latest_version(t["work_items"], ["work_item_id"], "last_synced").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("items"))
    return several.join(items, "id", "left").select("id", "claimants", F.coalesce("items", F.lit(0)).alias("items"))


#: name: (function, tables it reads)
PRODUCERS: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "organizations": (organization_seed, ("repos",)),
    "repositories": (repositories, ("repos",)),
    "work_items": (work_items, ("work_items", "repos")),
    "pull_requests": (pull_requests, ("git_pull_requests", "repos")),
    "reviews": (pull_request_reviews, ("git_pull_request_reviews", "git_pull_requests")),
    "deployments": (deployments, ("deployments", "repos")),
    "ci_runs": (ci_runs, ("ci_pipeline_runs", "repos")),
    "incidents": (incidents, ("operational_incidents",)),
    "dependencies": (dependencies, ("work_item_dependencies", "work_items")),
    "hierarchy": (hierarchy, ("work_items",)),
    "deployment_incidents": (deployment_incidents, ("deployment_incident_edges", "deployments", "operational_incidents")),
    "teams": (teams, ("team_project_ownership",)),
    "projects": (projects, ("team_project_ownership",)),
    "work_item_projects": (work_item_projects, ("work_items",)),
    "project_teams": (project_teams, ("team_project_ownership",)),
    "incident_repositories": (incident_repositories, ("operational_incidents", "service_mappings", "repos")),
    "work_item_teams": (work_item_teams, ("work_item_team_attributions", "work_items", "team_project_ownership")),
    "resolved_projects": (resolved_projects, ("work_items", "projects")),
}


def all_changes(t: Tables) -> DataFrame:
    """The changes of all producers whose tables are there."""
    return reduce(DataFrame.unionByName, [f(t).withColumn("producer", F.lit(n)) for n, (f, needs) in PRODUCERS.items() if all(x in t for x in needs)])
