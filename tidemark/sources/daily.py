"""Daily and forecast tables in the shape of the fact providers' own, derived from the star-schema tables.

Each statement runs unchanged in Spark and in DuckDB.  A subject has several rows a day, some
computed at the same time, and some keys are null.
"""

from __future__ import annotations

DAILY = {
    "repo_metrics_daily": """SELECT concat('org-', user_id % 5) AS org_id, concat('repo-', user_id % 25) AS repo_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at, event_id % 50 AS commits_count,
        event_id % 7 AS prs_merged, value / 3 AS median_pr_cycle_hours, value / 100 AS change_failure_rate, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS mttr_hours, event_id % 9 AS bus_factor,
        value / 77 AS code_ownership_gini FROM events""",
    "compounding_risk_daily": """SELECT concat('org-', user_id % 5) AS org_id, CASE WHEN event_id % 2 = 0 THEN 'repo' ELSE 'team' END AS scope,
        CASE WHEN event_id % 2 = 0 THEN concat('repo-', user_id % 25) ELSE concat('team-', user_id % 30) END AS scope_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at,
        CASE WHEN value > 40 THEN 'high' WHEN value > 15 THEN 'elevated' ELSE 'low' END AS severity, CASE WHEN event_id % 4 > 0 THEN value / 60 END AS compounding_risk FROM events""",
    "capacity_forecasts": """SELECT concat('org-', user_id % 5) AS org_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('team-', user_id % 30) END AS team_id,
        CASE WHEN event_id % 6 > 0 THEN concat('scope-', event_id % 6) END AS work_scope_id, date_trunc('hour', ts) AS computed_at, concat('fc-', event_id) AS forecast_id, value AS throughput_mean,
        value / 5 AS throughput_stddev, CASE WHEN event_id % 5 > 0 THEN event_id % 40 END AS p50_days, CASE WHEN value < 3 THEN 1 ELSE 0 END AS insufficient_history,
        CASE WHEN value > 30 THEN 1 ELSE 0 END AS high_variance, event_id % 90 AS backlog_size FROM events""",
    "investment_metrics_daily": """SELECT concat('org-', user_id % 5) AS org_id, concat('team-', user_id % 30) AS team_id, event_type AS investment_area,
        CASE WHEN event_id % 3 > 0 THEN concat('stream-', event_id % 3) ELSE '' END AS project_stream, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at, event_id % 12 AS delivery_units,
        event_id % 17 AS work_items_completed, event_id % 5 AS prs_merged, event_id % 1000 AS churn_loc, value AS cycle_p50_hours FROM events""",
    "estimate_coverage_metrics_daily": """SELECT concat('org-', user_id % 5) AS org_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('team-', user_id % 30) END AS team_id,
        concat('scope-', event_id % 4) AS work_scope_id, CASE WHEN event_id % 2 = 0 THEN 'jira' ELSE 'linear' END AS provider, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS computed_at,
        event_id % 30 AS estimated_count, event_id % 11 AS unestimated_count, event_id % 41 AS backlog_size, CASE WHEN event_id % 8 > 0 THEN value / 90 END AS ratio FROM events""",
    "recommendations_daily": """SELECT concat('org-', user_id % 5) AS org_id, concat('team-', user_id % 30) AS team_id, concat('rule-', event_id % 6) AS rule_id, 'v2' AS rule_version,
        CASE WHEN value > 40 THEN 'high' ELSE 'low' END AS severity, concat('because of ', event_type) AS title, concat('seen by ', user_id) AS rationale, 'none of it is left' AS success_criterion,
        date_trunc('hour', ts) - INTERVAL 7 DAY AS window_start, date_trunc('hour', ts) AS window_end, date_trunc('hour', ts) + INTERVAL 1 HOUR AS computed_at, CASE WHEN value > 10 THEN 1 ELSE 0 END AS fired FROM events""",
    "backfill_log": """SELECT concat('org-', user_id % 5) AS org_id, CASE event_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' WHEN 2 THEN 'linear' ELSE 'pagerduty' END AS provider, concat('job-', event_id % 97) AS job_id,
        event_id % 13 AS chunk_index, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, event_id % 700 AS items_synced, event_id % 9000 AS duration_ms,
        CASE WHEN event_type = 'error' THEN concat('code ', event_id % 600) ELSE '' END AS error_message, date_trunc('hour', ts) AS created_at FROM events""",
}
