"""Facts of subjects whose tables are computed daily: the newest row of each key at a time or within a range."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import stamp
from .versions import first_per_key


@dataclass(frozen=True)
class Daily:
    """Where a kind of facts lies.

    keys: what one row stands for, besides the organization; null keys count as empty.  at: the
    column that a question's time bounds, a date or a timestamp.  order: what decides between
    rows of one ``at``, newest first; rows equal in these are ordered by their fields, so the
    same one is taken every time.  keep: applied after the newest row is known, so that an older
    row never stands in for one that it leaves out.
    """

    table: str
    keys: tuple[str, ...]
    at: str
    order: tuple[str, ...]
    fields: tuple[str, ...]
    keep: str | None = None
    grain: str = "day"


KINDS = {
    "metrics": Daily("repo_metrics_daily", ("repo_id",), "day", ("computed_at",), ("commits_count", "prs_merged", "median_pr_cycle_hours", "change_failure_rate", "mttr_hours", "bus_factor", "code_ownership_gini")),
    "health": Daily("compounding_risk_daily", ("scope", "scope_id"), "day", ("computed_at",), ("severity", "compounding_risk")),
    "workload": Daily("capacity_forecasts", ("team_id", "work_scope_id"), "computed_at", ("forecast_id",), ("throughput_mean", "throughput_stddev", "p50_days", "insufficient_history", "high_variance", "backlog_size"), grain="instant"),
    "investment": Daily("investment_metrics_daily", ("team_id", "investment_area", "project_stream"), "day", ("computed_at",), ("delivery_units", "work_items_completed", "prs_merged", "churn_loc", "cycle_p50_hours")),
    "readiness": Daily("estimate_coverage_metrics_daily", ("team_id", "work_scope_id", "provider"), "day", ("computed_at",), ("estimated_count", "unestimated_count", "backlog_size", "ratio")),
    "operational_deficiencies": Daily("recommendations_daily", ("team_id", "rule_id"), "window_end", ("computed_at",), ("fired", "severity", "title", "rationale", "success_criterion", "rule_version", "window_start"), keep="fired = 1", grain="instant"),
    "source_health": Daily("backfill_log", ("provider",), "created_at", ("job_id", "chunk_index"), ("status", "items_synced", "duration_ms", "error_message"), grain="instant"),
}


def within(kind: Daily, start: dt.datetime | None, end: dt.datetime | None) -> Column:
    """Both ends count; a day counts if it has begun by the end, and from the day of the start on."""
    day = kind.grain == "day"
    bound = lambda t: stamp(t).cast("date") if day else stamp(t)
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(kind.at) >= bound(start))
    if end is not None:
        out = out & (F.col(kind.at) <= bound(end))
    return out


def read_daily(table: DataFrame, kind: Daily, end: dt.datetime | None = None, start: dt.datetime | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """org_id, keys, at and fields: one row per organization and key.

    ``subjects`` (org_id and the first key that names a subject) narrows the table before
    anything is ranked; rows without an organization belong to nobody.
    """
    df = table.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in kind.keys}).filter(within(kind, start, end) & F.col("org_id").isNotNull())
    if subjects is not None:
        df = df.join(subjects, subjects.columns, "left_semi")
    newest = [F.desc_nulls_last(c) for c in (kind.at, *kind.order, *kind.fields)]
    df = first_per_key(df, ["org_id", *kind.keys], newest)
    if kind.keep:
        df = df.filter(kind.keep)
    return df.select("org_id", *kind.keys, kind.at, *kind.fields)


def retention_state(found: DataFrame, oldest: DataFrame, end: dt.datetime | None, group: list[str]) -> DataFrame:
    """Per group: available, no_data, or not_applicable where the question lies before the oldest row that is kept.

    found: rows that answered; oldest: group and the oldest ``at`` of the table, also of groups
    that have no answer.
    """
    counts = found.groupBy(*group).agg(F.count("*").alias("rows"))
    out = oldest.join(counts, group, "left")
    before = F.lit(False) if end is None else F.col("oldest").cast("timestamp_ntz") > stamp(end)
    return out.select(*group, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "available").when(before, "not_applicable").otherwise("no_data").alias("state"))
