"""Keyed result stores: reuse, priors, supersession, epochs, guarded JSON."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import stamp
from .versions import first_per_key


def reusable(results: DataFrame, key: list[str], asked: DataFrame, now: dt.datetime, max_age: dt.timedelta) -> DataFrame:
    """For each request the newest stored result of the same key, young enough, of the same
    invalidation epoch and source watermark."""
    fresh = results.filter(F.col("created_at") >= stamp(now - max_age))
    newest = first_per_key(fresh, [*key, "epoch", "watermark"], [F.desc("created_at"), F.col("result_id")])
    same = asked.join(newest, [*key, "epoch", "watermark"])
    return first_per_key(same, ["request_id"], [F.desc("created_at"), F.col("result_id")])


def first_claims(claims: DataFrame, key: list[str], created: str, result: str, taken: DataFrame | None = None) -> DataFrame:
    """The earliest claim per key (ties: least result) that is not taken already."""
    first = first_per_key(claims, key, [F.col(created), F.col(result)])
    return first if taken is None else first.join(taken.select(*key), key, "left_anti")


def publish_prior(versions: DataFrame, pointers: DataFrame, key: list[str], payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append version n + 1 for each key of ``payloads`` and point at it."""
    last = versions.groupBy(*key).agg(F.max("version").alias("_last"))
    new = payloads.join(last, key, "left").withColumn("version", F.coalesce(F.col("_last"), F.lit(0)) + 1).drop("_last")
    moved = new.select(*key, "version")
    return versions.unionByName(new.select(*versions.columns)), pointers.join(moved, key, "left_anti").unionByName(moved.select(*pointers.columns))


def served_priors(versions: DataFrame, pointers: DataFrame, key: list[str], revoked: DataFrame) -> DataFrame:
    """The pointed-at versions without the revoked ones; no older one stands in."""
    return versions.join(pointers, [*key, "version"], "left_semi").join(revoked, [*key, "version"], "left_anti")


def bump_epoch(epochs: DataFrame, organizations: DataFrame) -> DataFrame:
    """One more for each organization named, from 1 for new ones; others stay."""
    named = organizations.select("org_id").distinct().withColumn("_up", F.lit(1))
    return epochs.join(named, "org_id", "full").select("org_id", (F.coalesce("epoch", F.lit(0)) + F.coalesce("_up", F.lit(0))).alias("epoch"))


def strictly_later(now: Column, before: Column) -> Column:
    """A change time that always grows, by a microsecond at least."""
    return F.greatest(now, before + F.expr("INTERVAL '0.000001' SECOND"))


def guarded_array(json: Column, field: str, element: str) -> Column:
    """The field as an array; empty if it is missing or no array."""
    raw = F.get_json_object(json, f"$.{field}")
    return F.coalesce(F.from_json(F.when(raw.startswith("["), raw), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def cleared(json: Column, field: str) -> Column:
    """Null where the field is a non-empty array, else the payload."""
    return F.when(F.size(guarded_array(json, field, "string")) > 0, F.lit(None)).otherwise(json)


def panel_evidence_valid(payload: Column) -> Column:
    """Two arrays of equal length of at least two, ids distinct texts, bits booleans; a null
    payload is valid, anything unclear is not."""
    raw = lambda f: F.get_json_object(payload, f"$.{f}")
    texts = F.from_json(raw("ids"), "array<string>")
    quoted = raw("ids").rlike(r'^\[\s*"[^"]*"(\s*,\s*"[^"]*")*\s*\]$')
    bits = raw("bits").rlike(r"^\[\s*(true|false)(\s*,\s*(true|false))*\s*\]$")
    flags = F.from_json(raw("bits"), "array<boolean>")
    good = quoted & bits & (F.size(texts) >= 2) & (F.size(texts) == F.size(flags)) & (F.size(F.array_distinct(texts)) == F.size(texts))
    return F.when(payload.isNull(), True).otherwise(F.coalesce(good, F.lit(False)))


def in_scope(scopes: Column, slug: Column) -> Column:
    """A scope pattern covers the repository: *, its name, or its owner with /*."""
    return F.exists(scopes, lambda s: (s == "*") | (s == slug) | (s.endswith("/*") & slug.startswith(F.regexp_replace(s, r"\*$", ""))))


def cap_lists(answer: DataFrame, group: list[str], kind: str, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """The first rows of each kind up to its cap, and how many of the kind were left out."""
    limit = F.lit(0)
    for name, n in caps.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    w = Window.partitionBy(*group, kind)
    ranked = answer.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - limit))
    return ranked.filter(F.col("place") <= limit)
