"""The state of context packets: totals, byte budget, status, warnings and actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import freshness, stamp


def self_sized(rest: Column) -> Column:
    """Bytes of a text that states its own size in digits, when all but these digits takes ``rest`` bytes."""
    size = rest + 1
    for _ in range(3):  # the digits grow at most once a turn
        size = rest + F.length(size.cast("string"))
    return size.cast("long")


def trim_to_bytes(df: DataFrame, group: list[str], rank: str, item: Column, base: int, most: int) -> DataFrame:
    """Drop a packet's last items until it takes at most ``most`` bytes: ``base``, the items, commas and its own size.

    Sizes only grow with items, so what stays is a prefix by rank.  Adds the bytes of the
    whole prefix up to a row and whether its packet lost items.  A packet holds a
    bounded number of items; a packet that has none left has no row.
    """
    w = Window.partitionBy(*group)
    before = w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    size = self_sized(base + F.sum("_bytes").over(before) + F.row_number().over(w.orderBy(rank)) - 1)
    sized = df.withColumn("_bytes", F.octet_length(item).cast("long")).withColumn("serialized_bytes", size)
    return sized.withColumn("truncated", F.max("serialized_bytes").over(w) > most).filter(F.col("serialized_bytes") <= most).drop("_bytes")


def packet_totals(items: DataFrame, group: list[str], tokens: Column, item: Column, base: int) -> DataFrame:
    """Items, estimated tokens and serialized bytes of each packet."""
    n = F.count(F.lit(1))
    return items.groupBy(*group).agg(n.alias("items_used"), F.sum(tokens.cast("long")).alias("estimated_tokens"), self_sized(base + F.sum(F.octet_length(item).cast("long")) + n - 1).alias("serialized_bytes"))


def packet_status(items: Column, candidates: Column, partial: Column, truncated: Column) -> Column:
    return F.when(items == 0, F.when(candidates > 0, "partial").when(partial, "degraded").otherwise("empty")).when(partial | truncated, "partial").otherwise("complete")


def packet_states(packets: DataFrame, items: DataFrame, stale: DataFrame, missing: DataFrame, packet: str = "packet") -> DataFrame:
    """Status, sorted warnings, and a check and a step for each rule that a packet's items name.

    packets: (packet, candidates, truncated), one row each; items: (packet, rule_id);
    stale: (packet, source); missing: (packet, source, reason).
    """
    named = items.groupBy(packet).agg(F.count("*").alias("items"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    late = stale.groupBy(packet).agg(F.collect_set(F.concat(F.lit("source_stale:"), "source")).alias("late"))
    gone = missing.groupBy(packet).agg(F.collect_set(F.concat(F.lit("source_unavailable:"), "source", F.lit(":"), "reason")).alias("gone"))
    df = packets.join(named, packet, "left").join(late, packet, "left").join(gone, packet, "left")
    none = F.array().cast("array<string>")
    n, partial = F.coalesce("items", F.lit(0)), F.col("gone").isNotNull()
    own = F.array_compact(F.array(
        F.when((n == 0) & (F.col("candidates") > 0), "context_filtered_or_truncated"),
        F.when((n == 0) & (F.col("candidates") == 0) & ~partial, "no_evidence_found"),
        F.when(F.col("truncated"), "context_truncated"),
    ))
    rules = F.coalesce("rules", none)
    return df.select(
        packet,
        packet_status(n, F.col("candidates"), partial, F.col("truncated")).alias("status"),
        F.array_sort(F.array_distinct(F.concat(own, F.coalesce("late", none), F.coalesce("gone", none)))).alias("warnings"),
        F.transform(rules, lambda r: F.concat(F.lit("check."), r)).alias("checks"),
        F.transform(rules, lambda r: F.concat(F.lit("step."), r)).alias("steps"),
    )


def quarantined_watermarks(sources: DataFrame, valid: DataFrame, quarantined: DataFrame, at: dt.datetime) -> DataFrame:
    """Per source: its newest valid row and how fresh that is, and how many rows were set aside, under which rules.

    A source of which nothing valid is left has no watermark and is missing, however new its
    invalid rows are.
    """
    newest = valid.groupBy("source").agg(F.max("observed_at").alias("watermark"))
    aside = quarantined.groupBy("source").agg(F.count("*").alias("quarantined"), F.array_sort(F.collect_set("broken")).alias("rules"))
    out = sources.select("source").distinct().join(newest, "source", "left").join(aside, "source", "left")
    return out.select(
        "source", "watermark", freshness(F.col("watermark"), stamp(at)).alias("freshness"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"),
    )
