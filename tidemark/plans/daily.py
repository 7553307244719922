"""Registered queries about facts of daily tables, each with its DuckDB statement."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily_facts import KINDS, read_daily, retention_state
from ..sources.daily import DAILY

AT, FROM, EARLY = dt.datetime(2024, 1, 15, 6), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 2)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = spark.sql(DAILY[name].replace("FROM events", "FROM {events}"), events=events)
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _shown(df: DataFrame) -> DataFrame:
    """Doubles to nine places, days as text."""
    return df.withColumns({c: F.round(c, 9) if kind == "double" else F.col(c).cast("string") for c, kind in df.dtypes if kind in ("double", "date")})


def daily(kind: str, start: dt.datetime | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(read_daily(_table(spark, sf_dir, KINDS[kind].table), KINDS[kind], AT, start))


def daily_retention(spark, sf_dir):
    """Which organizations' metrics answer for a time before most of them begin."""
    table = _table(spark, sf_dir, "repo_metrics_daily").filter("day > DATE '2024-01-02' OR org_id < 'org-2'")
    oldest = table.groupBy("org_id").agg(F.min("day").alias("oldest"))
    return retention_state(read_daily(table, KINDS["metrics"], EARLY), oldest, EARLY, ["org_id"])


def _statement(kind: str, keys: str, at: str, order: str, fields: str, high: str, low: str = "", keep: str = "true") -> str:
    named = [k.strip() for k in keys.split(",")]
    blank = ", ".join(f"coalesce({k}, '') AS {k}" for k in named)
    total = ", ".join(f"{c.strip()} DESC NULLS LAST" for c in f"{at}, {order}, {fields}".split(","))
    shown = ", ".join(c if c not in DOUBLES else f"round({c}, 9) AS {c}" for c in (x.strip() for x in fields.split(",")))
    return f"""WITH t AS ({DAILY[KINDS[kind].table]}), k AS (SELECT * REPLACE ({blank}) FROM t WHERE {at} <= {high} {f"AND {at} >= {low}" if low else ""}),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY org_id, {keys} ORDER BY {total}) = 1) SELECT org_id, {keys}, {at if at != 'day' else 'day::VARCHAR AS day'}, {shown} FROM n WHERE {keep}"""


DOUBLES = {"median_pr_cycle_hours", "change_failure_rate", "mttr_hours", "code_ownership_gini", "compounding_risk", "throughput_mean", "throughput_stddev", "cycle_p50_hours", "ratio"}
_DAY, _TIME, _LOW = "DATE '2024-01-15'", "TIMESTAMP '2024-01-15 06:00:00'", "DATE '2024-01-10'"
STATEMENTS = {
    "daily_metrics": _statement("metrics", "repo_id", "day", "computed_at", "commits_count, prs_merged, median_pr_cycle_hours, change_failure_rate, mttr_hours, bus_factor, code_ownership_gini", _DAY),
    "daily_health": _statement("health", "scope, scope_id", "day", "computed_at", "severity, compounding_risk", _DAY),
    "daily_workload": _statement("workload", "team_id, work_scope_id", "computed_at", "forecast_id", "throughput_mean, throughput_stddev, p50_days, insufficient_history, high_variance, backlog_size", _TIME),
    "daily_investment": _statement("investment", "team_id, investment_area, project_stream", "day", "computed_at", "delivery_units, work_items_completed, prs_merged, churn_loc, cycle_p50_hours", _DAY, _LOW),
    "daily_readiness": _statement("readiness", "team_id, work_scope_id, provider", "day", "computed_at", "estimated_count, unestimated_count, backlog_size, ratio", _DAY),
    "daily_operational_deficiencies": _statement("operational_deficiencies", "team_id, rule_id", "window_end", "computed_at", "fired, severity, title, rationale, success_criterion, rule_version, window_start", _TIME, keep="fired = 1"),
    "daily_source_health": _statement("source_health", "provider", "created_at", "job_id, chunk_index", "status, items_synced, duration_ms, error_message", _TIME),
    "daily_retention": f"""WITH t AS (SELECT * FROM ({DAILY["repo_metrics_daily"]}) WHERE day > DATE '2024-01-02' OR org_id < 'org-2'),
o AS (SELECT org_id, min(day) AS oldest, count(DISTINCT repo_id) FILTER (day <= DATE '2024-01-02') AS rows FROM t GROUP BY org_id)
SELECT org_id, rows, CASE WHEN rows > 0 THEN 'available' WHEN oldest > DATE '2024-01-02' THEN 'not_applicable' ELSE 'no_data' END AS state FROM o""",
}
QUERIES = {f"daily_{k}": partial(daily, k, FROM if k == "investment" else None) for k in KINDS} | {"daily_retention": daily_retention}
