"""Telemetry tables in the shape of the engine's sources, derived from the star-schema tables.

Each statement runs unchanged in Spark and in DuckDB, so the queries and the
statements they are held against read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

TELEMETRY = {
    "repos": """SELECT concat('repo-', n_nationkey) AS id, concat(lower(r_name), '/', lower(n_name)) AS repo, 'main' AS ref,
        CASE WHEN n_nationkey % 2 = 0 THEN '["core","api"]' ELSE 'none' END AS tags, TIMESTAMP '2001-12-01 00:00:00' AS last_synced,
        concat('org-', n_regionkey) AS org_id, 'github' AS provider FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "work_items": """SELECT concat('WI-', o_orderkey) AS work_item_id, concat('repo-', c_nationkey) AS repo_id, concat('org-', n_regionkey) AS org_id, 'jira' AS provider,
        concat(o_orderpriority, CASE WHEN k.v = 0 THEN ' item ' ELSE ' stale item ' END, o_orderkey) AS title,
        CASE WHEN k.v = 1 THEN 'todo' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'todo' END AS status,
        concat('proj-', o_custkey % 20) AS project_id, CASE WHEN o_orderkey % 7 = 0 THEN concat('WI-', o_orderkey % 97) END AS parent_id,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('https://tracker.example/', o_orderkey) ELSE 'no link' END AS url,
        o_orderdate AS created_at, CASE WHEN k.v = 0 THEN o_orderdate + INTERVAL 3 DAY ELSE o_orderdate END AS updated_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 9 DAY END AS completed_at,
        CASE WHEN k.v = 0 THEN o_orderdate + INTERVAL 10 DAY ELSE o_orderdate END AS last_synced
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v) k ON k.v = 0 OR o_orderkey % 5 = 0""",
    "work_item_dependencies": """SELECT concat('WI-', l_orderkey) AS source_work_item_id,
        CASE WHEN l_linenumber = 7 THEN concat('GONE-', l_partkey) ELSE concat('WI-', l_partkey) END AS target_work_item_id,
        CASE WHEN l_returnflag = 'R' THEN 'blocks' ELSE 'relates_to' END AS relationship_type, max(l_shipdate) AS last_synced, concat('org-', n_regionkey) AS org_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY l_orderkey, l_partkey, l_linenumber, l_returnflag, n_regionkey""",
    "git_commits": """SELECT DISTINCT concat('repo-', l_suppkey % 25) AS repo_id, md5(concat(l_orderkey, '-', l_linenumber)) AS hash,
        CASE WHEN l_linenumber = 2 THEN '' ELSE concat('fix part ', l_partkey) END AS message, l_shipdate AS committer_when FROM lineitem WHERE l_linenumber <= 3""",
    "git_commit_stats": """SELECT concat('repo-', l_suppkey % 25) AS repo_id, md5(concat(l_orderkey, '-', l_linenumber)) AS commit_hash, concat('src/f', l_partkey % 50, '.py') AS file_path,
        CAST(max(l_quantity) AS INT) AS additions, CAST(min(l_linenumber) AS INT) AS deletions, max(l_shipdate) AS last_synced FROM lineitem WHERE l_linenumber <= 3
        GROUP BY l_suppkey % 25, l_orderkey, l_linenumber, l_partkey % 50""",
    "git_pull_requests": """SELECT concat('repo-', c_nationkey) AS repo_id, o_orderkey AS number, concat('change ', o_orderkey) AS title,
        CASE WHEN o_orderstatus = 'F' THEN 'merged' ELSE 'open' END AS state, o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 20 DAY END AS merged_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 20 DAY END AS closed_at,
        concat('feature-', o_orderkey % 11) AS head_branch, CASE WHEN o_orderkey % 4 = 0 THEN 'release' ELSE 'main' END AS base_branch, o_orderdate + INTERVAL 30 DAY AS last_synced
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "git_pull_request_reviews": """SELECT concat('repo-', c_nationkey) AS repo_id, l_orderkey AS number, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS review_id,
        max(CASE WHEN l_returnflag = 'A' THEN 'approved' ELSE 'commented' END) AS state, max(l_shipdate) AS submitted_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, l_orderkey, l_linenumber, l_partkey""",
    "ci_pipeline_runs": """SELECT concat('repo-', user_id % 25) AS repo_id, concat('run-', event_id) AS run_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status,
        ts AS started_at, CASE WHEN value > 5 THEN ts + INTERVAL 1 HOUR END AS finished_at, CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'feature-1' END AS branch FROM events""",
    "deployments": """SELECT concat('repo-', user_id % 25) AS repo_id, concat('dep-', event_id % 400) AS deployment_id, CASE WHEN value > 50 THEN 'failed' ELSE 'succeeded' END AS status,
        CASE WHEN event_id % 2 = 0 THEN 'production' ELSE '' END AS environment, min(ts) AS started_at, max(ts) AS finished_at,
        CASE WHEN event_id % 3 = 0 THEN max(ts) END AS deployed_at, '' AS release_ref, 0.75 AS release_ref_confidence, max(ts) AS last_synced
        FROM events WHERE event_type = 'purchase' GROUP BY user_id % 25, event_id % 400, CASE WHEN value > 50 THEN 'failed' ELSE 'succeeded' END, event_id % 2, event_id % 3""",
    "operational_incidents": """SELECT concat('org-', user_id % 5) AS org_id, concat('inc-', event_id) AS id, concat('svc-', user_id % 40) AS service_id, concat('incident ', event_id) AS title,
        CASE WHEN value > 20 THEN 'open' ELSE 'resolved' END AS normalized_status, CASE WHEN value > 40 THEN 'high' ELSE 'low' END AS normalized_severity,
        ts AS started_at, CASE WHEN value <= 20 THEN ts + INTERVAL 2 DAY END AS resolved_at, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_deleted, ts AS observed_at
        FROM events WHERE event_type = 'error'""",
    "service_mappings": """SELECT concat('org-', m.v % 5) AS org_id, concat('svc-', m.v % 40) AS service_id, concat('repo-', m.v % 25) AS repo_id, concat('map-', m.v) AS id,
        CASE m.v % 4 WHEN 0 THEN 'admin_configuration' WHEN 1 THEN 'bounded_service_repository_heuristic' WHEN 2 THEN 'native' ELSE 'something else' END AS relationship_provenance,
        CASE WHEN m.v % 3 = 0 THEN 1.4 WHEN m.v % 3 = 1 THEN 0.6 END AS relationship_confidence, TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
        CASE WHEN m.v % 2 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS valid_to, CASE WHEN m.v % 9 = 0 THEN 0 ELSE 1 END AS is_active
        FROM (SELECT DISTINCT user_id AS v FROM events) m""",
    "file_hotspot_daily": """SELECT concat('repo-', user_id % 25) AS repo_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at, concat('src/f', event_id % 50, '.py') AS file_path,
        CAST(floor(max(value)) AS BIGINT) AS churn_loc_30d, count(*) AS cyclomatic_total FROM events GROUP BY user_id % 25, CAST(ts AS DATE), date_trunc('hour', ts), event_id % 50""",
    "file_complexity_snapshots": """SELECT concat('repo-', user_id % 25) AS repo_id, CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'next' END AS ref, CAST(ts AS DATE) AS as_of_day,
        date_trunc('day', ts) AS computed_at, concat('src/f', event_id % 50, '.py') AS file_path, count(*) AS cyclomatic_total
        FROM events GROUP BY user_id % 25, event_id % 2, CAST(ts AS DATE), date_trunc('day', ts), event_id % 50""",
    "work_graph_edges": """SELECT concat('edge-', event_id) AS edge_id, concat('WI-', event_id % 500) AS source_id, concat('WI-', user_id) AS target_id, event_type AS edge_type,
        concat('repo-', user_id % 25) AS repo_id, CASE WHEN event_id % 4 = 0 THEN 'native' WHEN event_id % 4 = 1 THEN 'derived' WHEN event_id % 4 = 2 THEN 'heuristic' ELSE 'explicit_text' END AS provenance,
        CAST(event_id % 11 AS DOUBLE) / 10.0 AS confidence, ts AS discovered_at FROM events""",
    "ai_workflow_runs": """SELECT concat('ai-', event_id) AS run_id, concat('repo-', user_id % 25) AS repo_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'assistant' END AS provider,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS run_kind, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'finished' END AS status, ts AS observed_at FROM events WHERE event_type = 'view'""",
    "ai_workflow_artifacts": """SELECT concat('art-', event_id) AS edge_id, concat('repo-', user_id % 25) AS repo_id, 'commit' AS artifact_type, concat('c', event_id) AS artifact_id,
        CASE event_id % 4 WHEN 0 THEN 'pr_body' WHEN 1 THEN 'branch_name' WHEN 2 THEN 'native' ELSE 'rumour' END AS source, 0.5 AS confidence, ts AS observed_at FROM events WHERE event_type = 'click'""",
    "ai_review_outcomes": """SELECT concat('out-', event_id) AS edge_id, concat('repo-', user_id % 25) AS repo_id, event_id AS pr_id, concat('ro-', event_id) AS review_outcome_id, 'accepted' AS outcome,
        CASE WHEN event_id % 2 = 0 THEN 'native' ELSE 'guess' END AS source, 0.5 AS confidence, ts AS observed_at FROM events WHERE event_type = 'signup'""",
    "deployment_incident_edges": """SELECT concat('di-', event_id) AS edge_id, concat('repo-', user_id % 25) AS repo_id, concat('dep-', event_id % 400) AS deployment_id,
        CASE WHEN event_id % 6 = 0 THEN 'none' ELSE concat('inc-', event_id + 1) END AS incident_id, CASE WHEN event_id % 3 = 0 THEN 'native' ELSE 'heuristic' END AS source, 0.6 AS confidence, ts AS observed_at
        FROM events WHERE event_type = 'purchase'""",
    "team_daily": """SELECT concat('team-', user_id % 30) AS team_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at, event_type AS rule_id, event_id,
        value AS metric, CASE WHEN value > 20 THEN TRUE ELSE FALSE END AS fired, CASE WHEN value > 40 THEN 'high' WHEN value > 15 THEN 'elevated' ELSE 'low' END AS severity FROM events""",
    "projects": """SELECT DISTINCT concat('proj-', o_custkey % 18) AS id, CASE WHEN o_custkey % 18 % 6 = 0 AND o_orderstatus = 'F' THEN 'linear' ELSE 'jira' END AS provider FROM orders""",
    "work_item_team_attributions": """SELECT concat('WI-', o_orderkey) AS work_item_id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('team-', o_custkey % 35) END AS team_id,
        CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS is_primary, o_orderdate AS computed_at FROM orders""",
    "team_project_ownership": """SELECT concat('org-', user_id % 5) AS org_id, 'jira' AS provider, concat('PK', user_id % 60) AS project_key, concat('team-', event_id % 30) AS team_id,
        ts AS valid_from, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 4 DAY END AS valid_to FROM events WHERE event_type = 'signup'""",
}


TABLE = re.compile(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b")


def telemetry(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables over the Parquet files of a folder."""
    out: list[DataFrame] = []
    read: dict[str, DataFrame] = {}
    for name in names:
        bases = {m[2] for m in TABLE.finditer(TELEMETRY[name])}
        statement = TABLE.sub(r"\1 {\2}", TELEMETRY[name])
        for t in bases - set(read):
            read[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df = spark.sql(statement, **{t: read[t] for t in bases})
        # date_trunc gives a zoned type here and a plain one there
        out.append(df.withColumns({c: df[c].cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"}))
    return out


def dependency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that ``work_item_dependencies`` groups, before they meet their orders.

    The statement joins by order, then by customer, then groups, and moves all lines each time.
    An order with a customer and nation is a work item, so whoever joins these rows with the
    work items as sources and takes the newest of each dependency gets what the statement gives.
    """
    named, _ = TELEMETRY["work_item_dependencies"].split(", max(l_shipdate)")
    df = spark.sql(f"{named}, l_shipdate AS last_synced FROM {{lineitem}}", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return df.withColumn("last_synced", F.col("last_synced").cast("timestamp_ntz"))


def with_tables(*names: str) -> str:
    """The WITH clause that defines the named tables in plain SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({TELEMETRY[n]})" for n in names)
