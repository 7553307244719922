"""The registered queries of the engine's own operators over the star-schema tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text, vocabulary
from ..operators import aggregates, facts, graph, paging, ranking, search, stores, temporal, versions
from ..sources import changes
from ..sources.evidence import CATALOG, Request
from ..sources.telemetry import dependency_lines, telemetry
from . import answers, daily, fact_rounds, packet, retrievals, rounds

NOW = dt.datetime(2024, 1, 31)
AS_OF = dt.datetime(2024, 1, 15)
ORDERS_AS_OF = dt.datetime(2000, 1, 1)
GOAL = "fix failed deployment of part fix"

#: Which time each evidence source is read at, and its other filters.
REQUESTS = {
    name: Request("org-3", "repo-8", as_of=AS_OF, now=NOW) for name in CATALOG
} | {
    "repository_freshness": Request("org-3", "repo-8", branch="main", now=NOW),
    "work_items": Request("org-3", "repo-8", as_of=ORDERS_AS_OF, time_window_days=700, now=NOW),
    "work_item_dependencies": Request("org-3", "repo-8", as_of=ORDERS_AS_OF, now=NOW),
    "git_commits": Request("org-3", "repo-8", as_of=ORDERS_AS_OF, time_window_days=365, now=NOW),
    "git_commit_files": Request("org-3", "repo-8", files=("src/f1.py", "src/f7.py"), now=NOW),
    "pull_requests": Request("org-3", "repo-8", branch="release", as_of=ORDERS_AS_OF, now=NOW),
    "pull_request_reviews": Request("org-3", "repo-8", branch="release", as_of=ORDERS_AS_OF, now=NOW),
    "ci_pipeline_runs": Request("org-3", "repo-8", branch="main", as_of=AS_OF, time_window_days=7, now=NOW),
}


def _evidence(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, needs, _ = CATALOG[name]
    return source(dict(zip(needs, telemetry(spark, sf_dir, *needs), strict=True)), REQUESTS[name])


def _facts(kind: str, t: dt.datetime, spark: SparkSession, sf_dir: str) -> DataFrame:
    table = facts.PROVIDERS[kind].table
    return facts.read_facts({table: telemetry(spark, sf_dir, table)[0]}, kind, t)


def _dependencies(blocking: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("work_items", "work_item_dependencies")
    return facts.dependency_facts(dict(zip(names, telemetry(spark, sf_dir, *names), strict=True)), blocking)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_dedup(spark, sf_dir):
    return versions.latest_version(telemetry(spark, sf_dir, "work_items")[0], ["work_item_id"], "last_synced").select("work_item_id", "title", "status", "updated_at")


def limit_one_by(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return versions.first_per_key(e, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def ownership_fold(spark, sf_dir):
    return versions.fold_ownership(telemetry(spark, sf_dir, "team_project_ownership")[0], ["org_id", "project_key", "team_id"], "valid_from", "valid_to")


def ambiguous_projects(spark, sf_dir):
    o = telemetry(spark, sf_dir, "team_project_ownership")[0].select("org_id", "project_key", "team_id").distinct()
    return versions.unambiguous(o, ["org_id", "project_key"])[1]


def source_watermarks(spark, sf_dir, rows="event_type <> 'view' OR user_id % 2 = 0"):
    e = _t(spark, sf_dir, "events").filter(rows).selectExpr("CASE WHEN event_type = 'click' THEN 'error' ELSE event_type END AS source", "ts")
    catalog = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view")], "source string")
    return aggregates.watermarks(temporal.as_of(e, "ts", dt.datetime(2024, 1, 30, 23)), catalog, "source", "ts", temporal.stamp(dt.datetime(2024, 1, 31, 20)))


def source_watermarks_all(spark, sf_dir):
    return source_watermarks(spark, sf_dir, "true")


def coverage_sets(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    out = aggregates.coverage(e, ["user_id"], "event_type", F.col("value") > 30)
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("considered", "available", "unavailable")])


def census_of_parts(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return aggregates.census(p, "p_partkey", ["p_brand", "p_size"])


def panel_consensus(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).alias("question"), F.col("o_custkey").alias("voter"), F.col("o_orderpriority").alias("value"))
    return aggregates.consensus(o, ["question"], "voter", "value")


def prior_curation(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("member"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("mode"))
    return aggregates.curate_priors(o, ["member"], "value", "mode", "P")


def timing_by_type(spark, sf_dir):
    return aggregates.timing_summary(_t(spark, sf_dir, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


def percentile_nearest_rank(spark, sf_dir):
    return aggregates.nearest_rank(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})


def percentile_floor_index(spark, sf_dir):
    return aggregates.floor_index(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


def evaluation_ratios(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(aggregates.ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))), 9).alias("precision"),
        F.round(aggregates.ratio(F.count_if(F.col("value") > 1000), F.count_if(F.col("value") > 100000)), 9).alias("error_rate"),
    )
    return e


def recall_at_k(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("score"))
    found = p.filter("p_partkey % 3 <> 0").select("p_brand", "p_partkey")
    out = aggregates.recall_at(p, found, ["p_brand"], "p_partkey", "score", 10)
    return out.select("p_brand", F.round("recall", 9).alias("recall"), F.round("tolerant_recall", 9).alias("tolerant_recall"))


def usage_windows(spark, sf_dir):
    return aggregates.usage(_t(spark, sf_dir, "events"), ["event_type"], "ts", "1 day", "user_id")


def shard_merge(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("arm"), "l_linenumber", F.col("l_quantity").cast("long").alias("calls"), F.col("l_returnflag").alias("tag"), "l_shipdate", (F.col("l_tax") < 0.09).alias("valid"))
    out = aggregates.merge_shards(s, ["arm"], ["l_linenumber", "calls"], "tag", "l_shipdate", "valid")
    return out.withColumn("tags", F.array_join("tags", ","))


def citation_equality(spark, sf_dir):
    i = _t(spark, sf_dir, "lineitem")
    a = i.filter("l_returnflag = 'A'").select((F.col("l_orderkey") % 300).alias("task"), (F.col("l_partkey") % 7).alias("item"))
    b = i.filter("l_returnflag = 'N'").select((F.col("l_orderkey") % 300).alias("task"), (F.col("l_partkey") % 7).alias("item"))
    return aggregates.set_equality(a, b, ["task"], "item")


def keyset_page(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    cursor = (temporal.stamp(dt.datetime(2024, 1, 3)), F.lit("500"))
    return paging.page(e.select("hour", "event_id", "event_type"), "hour", "event_id", 200, cursor)


def merged_change_page(spark, sf_dir):
    o, c = telemetry(spark, sf_dir, "git_pull_requests", "git_commits")
    return paging.merged_page({"pull_requests": o.select(F.col("last_synced").alias("at"), F.col("number").alias("key")), "commits": c.select(F.col("committer_when").alias("at"), F.col("hash").alias("key"))}, "at", "key", 300)


def goal_scores(spark, sf_dir):
    d = _t(spark, sf_dir, "part")
    return d.select("p_partkey", ranking.goal_score(F.col("p_type"), F.col("p_name"), "large red widget red of steel").alias("goal_score"))


def category_rules(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("commit", "incident", "deployment", "task", "pull_request"))), (F.col("event_id") % 5 + 1).cast("int")).alias("entity_type"))
    return e.select("event_id", "entity_type", vocabulary.category_rule(F.col("entity_type")).alias("r")).select("event_id", "entity_type", "r.category", "r.severity", "r.category_rank")


def greedy_dedup(spark, sf_dir, rows="l_linenumber <= 6"):
    i = _t(spark, sf_dir, "lineitem").filter(rows).select((F.col("l_suppkey") % 40).alias("packet"), "l_orderkey", "l_linenumber", "l_partkey")
    i = i.groupBy("packet", "l_orderkey").agg(F.min("l_linenumber").alias("line"), F.min("l_partkey").alias("part"))
    keys = [F.concat(F.lit("o"), F.col("l_orderkey") % 50), F.concat(F.lit("p"), F.col("part") % 60)]
    return ranking.greedy_distinct(i, ["packet"], [F.col("line"), F.col("l_orderkey")], keys)


def greedy_dedup_all(spark, sf_dir):
    return greedy_dedup(spark, sf_dir, "true")


def quota_allocation(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "value", F.element_at(F.array(*map(F.lit, vocabulary.CATEGORIES)), (F.col("event_id") % 4 + 1).cast("int")).alias("category"), (F.col("user_id") % 20).alias("packet"))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("packet").orderBy(F.desc("value"), "event_id")))
    return ranking.take_quota(e, ["packet"], "rank", "category", 13).select("packet", "event_id", "category", "rank")


def _costs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("packet"), "event_id", F.ceil("value").cast("long").alias("cost"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("packet").orderBy("event_id")))


def pack_stop_first(spark, sf_dir):
    return ranking.pack_stopping(_costs(spark, sf_dir), ["packet"], "rank", "cost", 500)


def pack_skip(spark, sf_dir):
    return ranking.pack_skipping(_costs(spark, sf_dir), ["packet"], "rank", "cost", 100)


def top_k_ties(spark, sf_dir):
    return ranking.top_with_ties(_t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", 5)


def token_estimates(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ranking.token_estimate(F.col("text"), F.col("lang"), F.col("source")).alias("tokens"))


def derived_ids(spark, sf_dir):
    s = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(":"), F.col("p_brand"), F.lit("%")).alias("raw"))
    i = identity.derive_id("part", F.col("raw"), F.col("p_partkey").cast("string"))
    return s.select("p_partkey", i.alias("id"), F.element_at(identity.id_segments(i), 1).alias("first_segment"), identity.derive_relationship("part_of", F.col("raw")).alias("relationship_id"))


def question_hashes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.substring("text", 1, 200), F.lit(" ?? ")).alias("q"))
    return d.select("doc_id", text.question_hash(F.col("q")).alias("hash"))


def question_hashes_all(spark, sf_dir):
    """Of whole texts."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.col("text"), F.lit(" ?? ")).alias("q"))
    return d.select("doc_id", text.question_hash(F.col("q")).alias("hash"))


def relation_names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.relation_name(F.concat_ws("-", "p_name", "p_type")).alias("relation"))


def pure_identifiers(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.col("event_id").cast("string"), F.concat(F.lit("run-"), F.col("event_id")), F.md5(F.col("event_id").cast("string")), F.concat(F.lit("fix "), F.col("event_id"))), (F.col("event_id") % 4 + 1).cast("int")).alias("label"))
    return e.select("event_id", text.is_pure_identifier(F.col("label")).alias("pure"))


def question_handles(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Why did PR #"), F.col("event_id"), F.lit(" break pipeline run "), F.col("event_id") + 10000, F.lit(" last month?")).alias("q"))
    return e.select("event_id", F.array_join(text.handles(F.col("q"), text.PULL_REQUEST), ",").alias("prs"), F.array_join(text.handles(F.col("q"), text.PIPELINE_RUN), ",").alias("runs"), temporal.window_days(F.col("q")).alias("days"))


def edge_validity(spark, sf_dir):
    w = telemetry(spark, sf_dir, "work_items")[0]
    w = versions.latest_version(w, ["work_item_id"], "last_synced").select("work_item_id", "parent_id", "created_at", "completed_at")
    parent = w.select(F.col("work_item_id").alias("parent_id"), F.col("created_at").alias("p_from"), F.col("completed_at").alias("p_to"))
    start, end = temporal.intersect_validity((F.col("created_at"), F.col("completed_at")), (F.col("p_from"), F.col("p_to")))
    return w.filter("work_item_id <> parent_id").join(parent, "parent_id").select("work_item_id", "parent_id", start.alias("valid_from"), end.alias("valid_to"))


def valid_time_read(spark, sf_dir):
    o = telemetry(spark, sf_dir, "team_project_ownership")[0]
    at = temporal.stamp(AS_OF)
    return o.filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), at)).groupBy("org_id", "team_id").agg(F.count("*").alias("projects"), F.count_if(F.col("valid_to").isNull()).alias("open_ended"))


def neighbours(spark, sf_dir):
    e = telemetry(spark, sf_dir, "work_graph_edges")[0].select("source_id", "target_id")
    return graph.undirected(e, "source_id", "target_id").groupBy("node").agg(F.count("*").alias("degree"))


def two_hop_walk(spark, sf_dir):
    d = telemetry(spark, sf_dir, "work_item_dependencies")[0].select("source_work_item_id", "target_work_item_id")
    seeds = spark.createDataFrame([("WI-1",), ("WI-22",), ("WI-333",)], "seed string")
    return graph.walk(d, seeds, 2, "source_work_item_id", "target_work_item_id")


def edge_admission(spark, sf_dir):
    e, w = telemetry(spark, sf_dir, "work_graph_edges", "work_items")
    e = e.select("edge_id", "source_id", "target_id", "repo_id", F.col("discovered_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    nodes = w.filter("status = 'done'").select(F.col("work_item_id").alias("node_id")).distinct()
    out = graph.admit_edges(e, nodes, F.col("repo_id") != "repo-3", temporal.stamp(AS_OF), temporal.stamp(dt.datetime(2024, 1, 20)))
    return out.select("edge_id", "reason")


def keyed_upsert(spark, sf_dir):
    w = telemetry(spark, sf_dir, "work_items")[0].select("work_item_id", "status", "last_synced")
    state, batch = w.filter("last_synced < TIMESTAMP_NTZ '1998-06-01 00:00:00'"), w.filter("last_synced >= TIMESTAMP_NTZ '1998-06-01 00:00:00'")
    return graph.upsert(versions.latest_version(state, ["work_item_id"], "last_synced"), batch, ["work_item_id"], [F.desc("last_synced")])


def tombstones(spark, sf_dir):
    i = telemetry(spark, sf_dir, "operational_incidents")[0]
    dead = i.filter("is_deleted = 1").select("service_id", F.col("observed_at").alias("effective_at"))
    return graph.apply_tombstones(i.select("id", "service_id", "observed_at"), dead, ["service_id"], "observed_at", "effective_at")


def orphaned_stubs(spark, sf_dir):
    d, w = telemetry(spark, sf_dir, "work_item_dependencies", "work_items")
    known = w.select(F.col("work_item_id").alias("node_id")).distinct()
    ends = d.select(F.col("target_work_item_id").alias("node_id")).distinct()
    return graph.insert_absent(known.withColumn("kind", F.lit("work_item")), ends.withColumn("kind", F.lit("stub")), ["node_id"])


def lexical_matches(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    q = spark.createDataFrame([(1, "large red widget"), (2, "blue | ring (steel)"), (3, "nothing here")], "query_id int, query string")
    out = search.lexical_search(search.inverted_index(p, "p_partkey", "t"), q, "p_partkey", 50)
    return out.select("query_id", "p_partkey", "matched", "place", "truncated", F.round("relevance", 9).alias("relevance"))


def vector_nearest(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    out = search.nearest(v, v.filter("vec_id < 5"), "vec_id", "embedding", "vec_id", 20, 0.05)
    return out.select("query_id", "hit_id", "place", F.round("similarity", 9).alias("similarity"), F.round(search.vector_relevance(F.col("similarity"), 0.05), 9).alias("relevance"))


def lexical_matches_all(spark, sf_dir):
    """The names of every fiftieth part are searched for in all parts."""
    p = _t(spark, sf_dir, "part")
    q = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    out = search.lexical_search_blocks(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t")), q, "p_partkey", "t", 50)
    return out.select("query_id", "p_partkey", "matched", "place", "truncated", F.round("relevance", 9).alias("relevance"))


def vector_nearest_all(spark, sf_dir):
    """Every fiftieth vector is searched for among all vectors."""
    v = _t(spark, sf_dir, "embeddings")
    out = search.nearest_blocks(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", 20, 0.05)
    return out.select("query_id", "hit_id", "place", F.round("similarity", 9).alias("similarity"), F.round(search.vector_relevance(F.col("similarity"), 0.05), 9).alias("relevance"))


def candidate_fusion(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("request"), (F.col("event_id") % 60).alias("subject"), F.element_at(F.array(*map(F.lit, ("lexical", "vector", "alias", "exact"))), (F.col("event_id") % 4 + 1).cast("int")).alias("mechanism"), (F.col("value") / 400).alias("confidence"), F.array(F.col("event_type")).alias("terms"))
    out = search.merge_candidates(e, ["request"], "subject")
    return out.select("request", "subject", F.array_join("terms", ",").alias("terms"), F.array_join("mechanisms", ",").alias("mechanisms"), F.round("base", 9).alias("base"), F.round("confidence", 9).alias("confidence"))


def commit_decisions(spark, sf_dir, rows="event_id % 3 = 0"):
    e = _t(spark, sf_dir, "events").filter(rows).select(F.col("user_id").alias("request"), F.col("event_id").alias("subject"), F.round(F.least(F.lit(1.0), 0.6 + F.col("value") / 100), 2).alias("confidence"), F.col("event_type"))
    out = search.commit_gate(e, ["request"], "subject", F.col("event_type") != "view", F.col("event_type").eqNullSafe("nothing"))
    return out.select("request", "outcome", "committed", F.round("confidence", 9).alias("confidence"), F.round("gap", 9).alias("gap"))


def commit_decisions_all(spark, sf_dir):
    return commit_decisions(spark, sf_dir, "true")


def identity_collisions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_size")).alias("term"), F.col("p_partkey").alias("subject"), F.when(F.col("p_partkey") % 2 == 0, "label").otherwise("alias").alias("cls"))
    return search.identity_claims(p, "term", "subject", "cls")


def floor_calibration(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("value") / 100).alias("similarity"))
    return search.calibrate_floor(e, "similarity", 0.9).select(F.round("floor", 9).alias("floor"), F.round("kept", 9).alias("kept"))


def margin_calibration(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("value") / 100).alias("margin"), (F.col("event_id") % 50 != 1).alias("correct"))
    return search.margin_threshold(e, "margin", "correct").select(F.round("largest_wrong", 9).alias("largest_wrong"), F.round("reach", 9).alias("reach"))


def _packet(spark, sf_dir):
    names = sorted({n for _, needs, _ in CATALOG.values() for n in needs})
    tables = dict(zip(names, telemetry(spark, sf_dir, *names), strict=True))
    return packet.assemble(tables, Request("org-3", "repo-8", now=NOW), GOAL)


def packet_items(spark, sf_dir):
    return _packet(spark, sf_dir).items.select("rank", "source", "category", "entity_type", "entity_id", "goal_score", "tokens", "provenance")


def _changes(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    producer, needs = changes.PRODUCERS[name]
    tables = dict(zip(needs, telemetry(spark, sf_dir, *needs), strict=True))
    if name == "dependencies":  # the producer joins the sources and takes the newest of each dependency
        tables["work_item_dependencies"] = dependency_lines(spark, sf_dir)
    return producer(tables)


def omitted_projects(spark, sf_dir):
    names = ("work_items", "projects")
    return changes.omitted_projects(dict(zip(names, telemetry(spark, sf_dir, *names), strict=True)))


def supersession_claims(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("member"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("result"))
    return stores.first_claims(o, ["member"], "created", "result")


def answer_reuse(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    results = e.select(F.col("event_id").alias("result_id"), (F.col("user_id") % 40).alias("question"), (F.col("event_id") % 2).alias("epoch"), F.col("event_type").alias("watermark"), F.col("ts").alias("created_at"))
    asked = e.filter("event_id % 10 = 0").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 40).alias("question"), F.lit(1).cast("long").alias("epoch"), F.lit("click").alias("watermark"))
    return stores.reusable(results, ["question"], asked, NOW, dt.timedelta(days=3)).select("request_id", "question", "result_id", "created_at")


def answer_reuse_all(spark, sf_dir):
    """Every event is a stored result and asks for the newest one of its own question, epoch and type."""
    e = _t(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("question"), (F.col("event_id") % 2).alias("epoch"), F.col("event_type").alias("watermark"))
    results = e.withColumnsRenamed({"event_id": "result_id", "ts": "created_at"})
    asked = e.drop("ts").withColumnRenamed("event_id", "request_id")
    return stores.reusable(results, ["question"], asked, NOW, dt.timedelta(days=3)).select("request_id", "question", "result_id", "created_at")


def scope_filter(spark, sf_dir):
    r = telemetry(spark, sf_dir, "repos")[0]
    scopes = F.array(F.lit("nothing"), F.when(F.col("id") == "repo-4", F.col("repo")).otherwise("region_1/*"), F.concat(F.split("repo", "/")[0], F.lit("x/*")))
    return r.select("id", stores.in_scope(scopes, F.col("repo")).alias("covered"))


def answer_caps(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("answer"), "event_type", "event_id")
    return stores.cap_lists(e, ["answer"], "event_type", [F.col("event_id")], {"click": 10, "error": 25, "view": 3})


def fact_states(spark, sf_dir):
    ci = _facts("continuous_integration", AS_OF, spark, sf_dir).unionByName(_facts("deployments", AS_OF, spark, sf_dir))
    kinds = spark.createDataFrame([(k,) for k in ("continuous_integration", "deployments", "status", "evidence")], "fact_kind string")
    return facts.fact_coverage(ci, kinds, list(facts.PROVIDERS))


def alias_names(spark, sf_dir):
    return changes.repository_aliases(dict(repos=telemetry(spark, sf_dir, "repos")[0]))


def tag_lists(spark, sf_dir):
    r = telemetry(spark, sf_dir, "repos")[0]
    return r.select("id", text.canonical_list(text.json_array_or_empty(F.col("tags")), 3, 5).alias("tags"))


def search_texts(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.search_text(F.col("p_name"), F.lit(" "), F.concat(F.lit(" "), F.col("p_brand")), F.col("p_type"), most=20).alias("body"))


def parent_lift(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    found = e.filter("event_id % 7 = 0").select((F.col("user_id") % 9).alias("request"), F.col("event_id").alias("subject"), (F.col("value") / 1000).alias("confidence"))
    owners = e.filter("event_id % 14 = 0").select(F.col("event_id").alias("subject"), F.concat(F.lit("r"), F.col("user_id") % 5).alias("parent"))
    owners = owners.unionByName(e.filter("event_id % 42 = 0").select(F.col("event_id").alias("subject"), F.lit("other").alias("parent")))
    return search.lift_to_parents(found, owners, ["request"], "subject", "parent").withColumn("confidence", F.round("confidence", 9))


def parent_lift_all(spark, sf_dir):
    """Views belong to nobody, other events to their user, purchases to the shop as well."""
    e = _t(spark, sf_dir, "events")
    found = e.select((F.col("user_id") % 9).alias("request"), F.col("event_id").alias("subject"), (F.col("value") / 1000).alias("confidence"))
    owners = e.filter("event_type <> 'view'").select(F.col("event_id").alias("subject"), F.concat(F.lit("u"), "user_id").alias("parent"))
    owners = owners.unionByName(e.filter("event_type = 'purchase'").select(F.col("event_id").alias("subject"), F.lit("shop").alias("parent")))
    return search.lift_to_parents(found, owners, ["request"], "subject", "parent").withColumn("confidence", F.round("confidence", 9))


FACT_TIMES = {"actual_completion": ORDERS_AS_OF, "pull_requests": ORDERS_AS_OF, "reviews": ORDERS_AS_OF, "identity": ORDERS_AS_OF, "membership": ORDERS_AS_OF, "status": ORDERS_AS_OF, "work": ORDERS_AS_OF}

PLAIN = (
    version_dedup, limit_one_by, ownership_fold, ambiguous_projects, source_watermarks, coverage_sets, census_of_parts, panel_consensus, prior_curation, timing_by_type,
    percentile_nearest_rank, percentile_floor_index, evaluation_ratios, recall_at_k, usage_windows, shard_merge, citation_equality, keyset_page, merged_change_page, goal_scores,
    category_rules, greedy_dedup, quota_allocation, pack_stop_first, pack_skip, top_k_ties, token_estimates, derived_ids, question_hashes, relation_names, pure_identifiers,
    question_handles, edge_validity, valid_time_read, neighbours, two_hop_walk, edge_admission, keyed_upsert, tombstones, orphaned_stubs, lexical_matches, vector_nearest,
    candidate_fusion, commit_decisions, identity_collisions, floor_calibration, margin_calibration, packet_items,
    supersession_claims, answer_reuse, scope_filter, answer_caps, fact_states, alias_names, tag_lists, search_texts, parent_lift,
    omitted_projects, lexical_matches_all, vector_nearest_all, question_hashes_all, source_watermarks_all, greedy_dedup_all, commit_decisions_all, answer_reuse_all, parent_lift_all,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable] = {f.__name__: f for f in (*PLAIN, *answers.QUERIES, *rounds.QUERIES, *fact_rounds.QUERIES, *retrievals.QUERIES)}
    found |= daily.QUERIES
    found |= {f"evidence_{n}": partial(_evidence, n) for n in CATALOG}
    found |= {f"facts_{n}": partial(_facts, n, FACT_TIMES.get(n, AS_OF)) for n in facts.PROVIDERS}
    found |= {"facts_blockers": partial(_dependencies, True), "facts_required_children": partial(_dependencies, False)}
    found |= {f"changes_{n}": partial(_changes, n) for n in changes.PRODUCERS}
    return found
