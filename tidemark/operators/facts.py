"""Point-in-time facts about subjects, one long row per field."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import as_of, stamp
from .versions import first_per_key, latest_version

MAX_LONG = 9223372036854775807


def long_facts(df: DataFrame, kind: str, subject: Column, fields: dict[str, Column]) -> DataFrame:
    """(fact_kind, subject_id, field, value); null fields are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    rows = df.select(F.lit(kind).alias("fact_kind"), subject.alias("subject_id"), F.explode(pairs).alias("_f"))
    return rows.select("fact_kind", "subject_id", "_f.field", "_f.value").filter("value IS NOT NULL")


def representable(value: Column) -> Column:
    """Unsigned values beyond a signed long are left out, never wrapped."""
    return F.when(value <= MAX_LONG, value)


def pull_request_state(t: Column) -> Column:
    done = lambda c: F.col(c).isNotNull() & (F.col(c) <= t)
    return F.when(done("merged_at"), "merged").when(done("closed_at"), "closed").otherwise("open")


def finished_or(column: str, status: Column, running: str, t: Column) -> Column:
    """The recorded status once the end lies at or before ``t``, else what it was then."""
    return F.when(F.col(column).isNotNull() & (F.col(column) <= t), status).otherwise(running)


@dataclass(frozen=True)
class Provider:
    """table and key of the subjects, the columns, and how history is read.

    latest: keys of a daily table of which the newest row at the time counts; keep: a
    filter after that; existed: a timestamp that must not lie after the time; None for
    facts without history.
    """

    table: str
    subject: str
    fields: Callable[[Column], dict[str, Column]]
    existed: str | None = None
    latest: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    keep: str | None = None
    version: str | None = None


def _same(*names: str) -> Callable[[Column], dict[str, Column]]:
    return lambda t: {n: F.col(n) for n in names}


PROVIDERS: dict[str, Provider] = {
    "identity": Provider("work_items", "work_item_id", _same("title", "provider"), version="last_synced"),
    "membership": Provider("work_items", "work_item_id", _same("repo_id", "org_id"), version="last_synced"),
    "status": Provider("work_items", "work_item_id", _same("status"), version="last_synced"),
    "work": Provider("work_items", "work_item_id", _same("title"), version="last_synced"),
    "actual_completion": Provider("work_items", "work_item_id", lambda t: {"completed": F.coalesce(F.col("completed_at") <= t, F.lit(False))}, existed="created_at", version="last_synced"),
    "pull_requests": Provider("git_pull_requests", "number", lambda t: {"title": F.col("title"), "state": pull_request_state(t)}, existed="created_at"),
    "reviews": Provider("git_pull_request_reviews", "review_id", _same("state"), existed="submitted_at"),
    "continuous_integration": Provider("ci_pipeline_runs", "run_id", lambda t: {"status": finished_or("finished_at", F.col("status"), "running", t)}, existed="started_at"),
    "deployments": Provider("deployments", "deployment_id", lambda t: {"status": finished_or("finished_at", F.col("status"), "in_progress", t), "environment": F.nullif(F.col("environment"), F.lit(""))}, existed="started_at"),
    "incidents": Provider("operational_incidents", "id", lambda t: {"status": finished_or("resolved_at", F.lit("resolved"), "open", t)}, existed="started_at", keep="is_deleted = 0"),
    "metrics": Provider("team_daily", "team_id", _same("metric"), existed="day", latest=("team_id",), order=("day", "computed_at", "event_id")),
    "health": Provider("team_daily", "team_id", _same("metric", "severity"), existed="day", latest=("team_id",), order=("day", "computed_at", "event_id")),
    "workload": Provider("team_daily", "team_id", _same("metric", "rule_id"), existed="day", latest=("team_id", "rule_id"), order=("computed_at", "event_id")),
    "investment": Provider("team_daily", "team_id", _same("rule_id", "metric"), existed="day", latest=("team_id", "rule_id"), order=("day", "computed_at", "event_id")),
    "readiness": Provider("team_daily", "team_id", _same("rule_id", "metric"), existed="day", latest=("team_id", "rule_id", "severity"), order=("day", "computed_at", "event_id")),
    "operational_deficiencies": Provider("team_daily", "team_id", _same("rule_id", "severity"), existed="day", latest=("team_id", "rule_id"), order=("day", "computed_at", "event_id"), keep="fired"),
    "source_health": Provider("team_daily", "rule_id", _same("severity", "computed_at"), existed="day", latest=("rule_id",), order=("computed_at", "day", "event_id")),
}


def read_facts(tables: dict[str, DataFrame], kind: str, t: dt.datetime, subjects: DataFrame | None = None) -> DataFrame:
    """The facts of one kind at ``t``, of all subjects or of those in ``subjects`` (subject_id)."""
    p = PROVIDERS[kind]
    df = tables[p.table]
    if subjects is not None:
        df = df.join(subjects.select(F.col("subject_id").alias(p.subject)), p.subject, "left_semi")
    if p.version:
        df = latest_version(df, [p.subject], p.version)
    if p.existed:
        existed = F.col(p.existed)
        df = as_of(df, existed.cast("timestamp_ntz"), t)
    if p.latest:
        df = first_per_key(df, list(p.latest), [F.col(c).desc() for c in p.order])
    if p.keep:  # after the ranking: an old row must not stand in for a newer one that is filtered
        df = df.filter(p.keep)
    return long_facts(df, kind, F.col(p.subject).cast("string"), p.fields(stamp(t)))


def dependency_facts(tables: dict[str, DataFrame], blocking: bool) -> DataFrame:
    """What blocks an item (incoming ``blocks``), or what it requires (outgoing, all else)."""
    key = ["source_work_item_id", "target_work_item_id", "relationship_type"]
    blocks = F.lower("relationship_type") == "blocks"
    own, other = ("target_work_item_id", "source_work_item_id") if blocking else ("source_work_item_id", "target_work_item_id")
    # of a version only its key is told, so the versions are made one without being sorted
    d = tables["work_item_dependencies"].filter(blocks if blocking else ~blocks).select(*key).distinct()
    items = tables["work_items"].select(F.col("work_item_id").alias(own))
    return long_facts(d.join(items, own, "left_semi"), "blockers" if blocking else "required_children", F.col(own), {"related": F.col(other)})


def fact_coverage(facts: DataFrame, kinds: DataFrame, configured: list[str]) -> DataFrame:
    """Per kind: unconfigured, no_data or available with its number of subjects."""
    counts = facts.groupBy("fact_kind").agg(F.count_distinct("subject_id").alias("subjects"))
    state = F.when(~F.col("fact_kind").isin(*configured), "unconfigured").when(F.col("subjects").isNull(), "no_data").otherwise("available")
    return kinds.join(counts, "fact_kind", "left").select("fact_kind", F.coalesce("subjects", F.lit(0)).alias("subjects"), state.alias("state"))
