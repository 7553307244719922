"""A context packet: evidence of all sources, validated, ranked, distinct, within quota and budget."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import AVAILABILITY, PROVENANCE_RANK, category_rule
from ..operators import packets
from ..operators.ranking import evidence_order, goal_score, greedy_distinct, pack_skipping, provenance_order, take_quota, token_estimate
from ..sources.evidence import Request, Tables, catalog_sources
from ..streaming.files import scratch


@dataclass(frozen=True)
class Limits:
    items: int = 25
    tokens: int = 4000
    per_source: int = 100
    least_confidence: float = 0.5
    bytes: int = 65_536
    base_bytes: int = 512
    #: only items of these, if any are named
    categories: tuple[str, ...] = ()


def broken_rule(availability: Column | None = None) -> Column:
    """The first rule that an evidence row breaks, or null."""
    between = lambda c, a, b: F.char_length(F.col(c)).between(a, b)
    uri = F.col("safe_uri")
    rules = {
        "id": between("evidence_ref_id", 8, 256), "system": between("system", 1, 100), "entity_type": between("entity_type", 1, 100), "entity_id": between("entity_id", 1, 1024),
        "label": between("display_label", 1, 1000), "citation": between("citation", 1, 2000), "uri": (uri == "") | (uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.char_length(uri) <= 2048)),
        "observed_at": F.col("observed_at").isNotNull(), "confidence": F.col("confidence").between(0, 1) & ~F.isnan("confidence"), "provenance": F.col("provenance").isin(*PROVENANCE_RANK),
    }
    if availability is not None:
        rules["availability"] = availability.isin(*AVAILABILITY)
    out = F.lit(None).cast("string")
    for name, good in reversed(rules.items()):
        out = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(out)
    return out


#: How many sources are read at a time.
SOURCES_AT_ONCE = 6


def gather(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], folder: str) -> DataFrame:
    """All sources' rows with the rule that each breaks, every source by a job of its own.

    One plan over seventeen sources is planned anew with each of its hundred stages; jobs of
    one source are small and run beside each other.  What is stored is the evidence of one
    request, and each table is read once for it.
    """

    def store(name: str) -> tuple[str, object]:
        df = sources[name]().withColumn("broken", broken_rule())
        df.write.parquet(f"{folder}/{name}")
        return f"{folder}/{name}", df.schema

    with ThreadPoolExecutor(SOURCES_AT_ONCE) as pool:
        stored = list(pool.map(store, sources))
    return spark.read.schema(stored[0][1]).parquet(*[path for path, _ in stored])


def best_of_sources(rows: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows of each source, one per entity; ranks stop at their limit before rows are shuffled."""
    order = provenance_order()
    entity = Window.partitionBy("source", "system", "entity_type", "entity_id").orderBy(*order)
    once = rows.withColumn("_nth", F.row_number().over(entity)).filter("_nth = 1")
    return once.withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def ranked(evidence: DataFrame, goal: str) -> DataFrame:
    """Evidence with category, goal score, token cost and its rank from 1; a rule and claim of its own count before its type's."""
    own = [F.col(c) if c in evidence.columns else None for c in ("own_rule", "own_claim")]
    df = evidence.withColumn("goal_score", goal_score(F.col("citation"), F.col("display_label"), goal)).withColumn("_rule", category_rule(F.col("entity_type"), *own)).select("*", "_rule.*").drop("_rule")
    why = [F.col("why")] if "why" in df.columns else []
    df = df.withColumn("tokens", token_estimate(F.col("display_label"), F.col("citation"), F.col("rule_id"), *why))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("packet").orderBy(*evidence_order())))


def selected(rows: DataFrame, limits: Limits) -> DataFrame:
    """Of a packet's ranked rows those that are distinct, within quota, tokens and bytes."""
    entity = F.concat_ws("\x00", "system", "entity_type", "entity_id")
    keys = [F.concat(F.lit("r"), "evidence_ref_id"), F.concat(F.lit("e"), entity)]
    if "content_digest" in rows.columns:  # sources that have none leave it out
        keys.append(F.when(F.col("content_digest") != "", F.concat(F.lit("c"), "content_digest")))
    if limits.categories:
        rows = rows.filter(F.col("category").isin(*limits.categories))
    rows = greedy_distinct(rows, ["packet"], [F.col("rank")], keys)
    rows = take_quota(rows, ["packet"], "rank", "category", limits.items)
    rows = pack_skipping(rows, ["packet"], "rank", "tokens", limits.tokens)
    return packets.trim_to_bytes(rows, ["packet"], "rank", item_json(), limits.base_bytes, limits.bytes)


def item_json() -> Column:
    """An item as it is counted in bytes."""
    return F.to_json(F.struct("rank", "evidence_ref_id", "system", "entity_type", "entity_id", "display_label", "citation", "rule_id", "category", "claim"))


@dataclass(frozen=True)
class Packet:
    """Frames of one packet, read from where they are stored; ``unavailable`` names sources without a table."""

    items: DataFrame
    quarantined: DataFrame
    watermarks: DataFrame
    totals: DataFrame
    state: DataFrame
    unavailable: dict[str, str] = field(default_factory=dict)


def assemble(tables: Tables, request: Request, goal: str = "", limits: Limits = Limits()) -> Packet:
    """The packet's items in order, the rows that break a rule, watermarks without them, totals, status, warnings and actions.

    Every source is read once.  A row that breaks a rule makes the packet partial and does not
    count for its source's watermark.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = scratch(spark, "packet")
    sources, unavailable = catalog_sources(tables, request)
    rows = gather(spark, sources, f"{folder}/rows")
    good = rows.filter("broken IS NULL").drop("broken")
    tops = best_of_sources(good.filter(F.col("confidence") >= limits.least_confidence), limits.per_source).withColumn("packet", F.lit(1))
    candidates = ranked(tops, goal)
    candidates.write.parquet(f"{folder}/candidates")
    candidates = spark.read.schema(candidates.schema).parquet(f"{folder}/candidates")
    items = selected(candidates, limits)
    items.write.parquet(f"{folder}/items")
    items = spark.read.schema(items.schema).parquet(f"{folder}/items")
    bad = rows.filter("broken IS NOT NULL")
    names = spark.createDataFrame([(n,) for n in sources], "source string")
    marks = packets.quarantined_watermarks(names, good, bad, request.now)
    one = spark.range(1).select(F.lit(1).alias("packet"))
    counts = candidates.groupBy("packet").agg(F.count("*").alias("candidates")).join(items.groupBy("packet").agg(F.count("*").alias("_items"), F.bool_or("truncated").alias("_cut")), "packet", "left")
    every = one.join(counts, "packet", "left").select("packet", F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.coalesce("_cut", F.lit(False)) | (F.coalesce("_items", F.lit(0)) < F.coalesce("candidates", F.lit(0)))).alias("truncated"))
    late = marks.filter("freshness = 'stale'").select(F.lit(1).alias("packet"), "source")
    missing = spark.createDataFrame([(1, n, why) for n, why in unavailable.items()], "packet int, source string, reason string")
    broken = bad.select(F.lit(1).alias("packet"), "source", F.concat(F.lit("invalid_"), "broken").alias("reason")).distinct()
    state = packets.packet_states(every, items.select("packet", "rule_id"), late, missing.unionByName(broken))
    totals = packets.packet_totals(items, ["packet"], F.col("tokens"), item_json(), limits.base_bytes)
    return Packet(items.orderBy("rank"), bad, marks, totals, state, unavailable)
