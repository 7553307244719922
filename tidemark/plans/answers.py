"""Registered queries about packets and choices, each with its DuckDB statement."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import FACT_KINDS
from ..operators import choices, packets, ranking, search
from ..sources.telemetry import telemetry, with_tables

KINDS = ("click", "signup", "error", "refund", "purchase")
#: The first kinds of facts, as many as the orders are dealt to.
DEALT = 12


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _item() -> Column:
    return F.to_json(F.struct("event_id", "event_type"))


def byte_trim(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("packet"), "event_id", "event_type")
    return packets.trim_to_bytes(e, ["packet"], "event_id", _item(), 40, 400)


def packet_totals(spark, sf_dir):
    e = _events(spark, sf_dir)
    return packets.packet_totals(e, ["user_id"], ranking.token_estimate(F.col("event_type"), F.col("event_id").cast("string")), _item(), 100)


def packet_states(spark, sf_dir):
    """Every user is a packet: of its candidates above 5 those above 40 are items, eight at most."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "packet")
    all_of = e.groupBy("packet").agg(F.count_if(F.col("value") > 5).alias("candidates"), (F.count_if(F.col("value") > 40) > 8).alias("truncated"))
    items = e.filter("value > 40").select("packet", F.concat(F.lit("rule."), "event_type").alias("rule_id"))
    late = e.groupBy("packet", F.col("event_type").alias("source")).agg(F.max("ts").alias("at")).filter(F.col("at") < F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz"))
    gone = e.filter("event_type = 'error' AND value < 1").select("packet", F.col("event_type").alias("source"), F.lit("timeout").alias("reason"))
    out = packets.packet_states(all_of, items, late, gone)
    return out.select("packet", "status", *[F.array_join(c, ",").alias(c) for c in ("warnings", "checks", "steps")])


def margin_commits(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("request"), F.col("event_id").alias("subject"), F.col("value").alias("similarity"), "event_type")
    return choices.margin_commit(e, ["request"], "subject", F.col("event_type").isin("click", "purchase"), F.col("subject") % 3 != 0, 5.0).withColumn("margin", F.round("margin", 9))


def tiered_candidates(spark, sf_dir):
    """Errors belong to the event before them; the greatest values are committed."""
    e = _events(spark, sf_dir).select((F.col("event_id") % 97).alias("request"), F.col("event_id").alias("subject"), "value", "event_type")
    parents = e.filter("event_type = 'error'").select("request", (F.col("subject") - 97).alias("subject"))
    return choices.tiered(e, ["request"], "subject", [F.desc("value"), F.col("subject")], F.col("value") > 60, parents, 20).select("request", "subject", "tier", "place")


def clarification_prompts(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "value", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("label"))
    return choices.clarification(e, ["user_id"], "label", [F.desc("value"), F.col("event_id")])


def cohorts(spark, sf_dir):
    return choices.cohort(_events(spark, sf_dir).filter("value > 20"), ["event_type"], "user_id", "event_id", 100)


def missing_kinds(spark, sf_dir):
    return choices.missing_kinds(_events(spark, sf_dir), ["user_id"], "event_type", list(KINDS)).withColumn("missing", F.array_join("missing", ","))


def read_subjects(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    of = lambda status: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("subject"))
    return choices.with_derived(of("F"), of("O"), ["subject"])


def coarsest_grains(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "click", "").when(F.col("value") > 45, "day").otherwise("instant").alias("part"))
    return choices.coarsest_grain(e, ["user_id"], "part")


def edge_order(spark, sf_dir):
    """A relevance where the edge is surer than a half, else a score, which may exceed 1."""
    e = telemetry(spark, sf_dir, "work_graph_edges")[0]
    c = F.col("confidence")
    out = choices.ordered_edges(e, ["source_id"], search.result_confidence(F.when(c > 0.5, c), c * 20), "edge_id")
    return out.select("source_id", "edge_id", "place", F.round("confidence", 9).alias("confidence"))


def fact_bundle(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.element_at(F.array(*map(F.lit, FACT_KINDS[:DEALT])), (F.col("o_orderkey") % DEALT + 1).cast("int"))
    f = o.select(kind.alias("fact_kind"), F.col("o_orderstatus").alias("subject_kind"), F.col("o_orderkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("source"))
    return choices.capped_facts(f, list(FACT_KINDS))


QUERIES = (byte_trim, packet_totals, packet_states, margin_commits, tiered_candidates, clarification_prompts, cohorts, missing_kinds, read_subjects, coarsest_grains, edge_order, fact_bundle)

_JSON = """strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')"""


def _sized(rest: str) -> str:
    """The least size that holds its own digits."""
    return f"list_min(list_filter(list_transform(range(1, 12), lambda d: ({rest}) + d), lambda s: strlen(s::VARCHAR) <= s - ({rest})))"


STATEMENTS = {
    "byte_trim": f"""WITH b AS (SELECT user_id AS packet, event_id, event_type, (40 + sum({_JSON}) OVER w + row_number() OVER w - 1)::BIGINT AS rest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        s AS (SELECT packet, event_id, event_type, {_sized('rest')} AS serialized_bytes FROM b), m AS (SELECT *, max(serialized_bytes) OVER (PARTITION BY packet) > 400 AS truncated FROM s) SELECT * FROM m WHERE serialized_bytes <= 400""",
    "packet_totals": f"""WITH b AS (SELECT user_id, count(*) AS items_used, sum((strlen(event_type) + strlen(event_id::VARCHAR) + 3) // 4)::BIGINT AS estimated_tokens, (100 + sum({_JSON}) + count(*) - 1)::BIGINT AS rest FROM events GROUP BY user_id)
        SELECT user_id, items_used, estimated_tokens, {_sized('rest')} AS serialized_bytes FROM b""",
    "packet_states": """WITH p AS (SELECT user_id AS packet, count(*) FILTER (value > 5) AS candidates, count(*) FILTER (value > 40) AS items, count(*) FILTER (event_type = 'error' AND value < 1) > 0 AS gone FROM events GROUP BY 1),
        r AS (SELECT DISTINCT user_id AS packet, 'rule.' || event_type AS rule FROM events WHERE value > 40), a AS (SELECT packet, string_agg('check.' || rule, ',' ORDER BY rule) AS checks, string_agg('step.' || rule, ',' ORDER BY rule) AS steps FROM r GROUP BY 1),
        w AS (SELECT user_id AS packet, 'source_stale:' || event_type AS w FROM events GROUP BY user_id, event_type HAVING max(ts) < TIMESTAMP '2024-01-10' UNION SELECT packet, 'source_unavailable:error:timeout' FROM p WHERE gone
          UNION SELECT packet, 'context_truncated' FROM p WHERE items > 8 UNION SELECT packet, 'context_filtered_or_truncated' FROM p WHERE items = 0 AND candidates > 0 UNION SELECT packet, 'no_evidence_found' FROM p WHERE items = 0 AND candidates = 0 AND NOT gone),
        s AS (SELECT packet, string_agg(w, ',' ORDER BY w) AS warnings FROM w GROUP BY 1)
        SELECT packet, CASE WHEN items > 0 AND (gone OR items > 8) THEN 'partial' WHEN items > 0 THEN 'complete' WHEN candidates > 0 THEN 'partial' WHEN gone THEN 'degraded' ELSE 'empty' END AS status,
        coalesce(warnings, '') AS warnings, coalesce(checks, '') AS checks, coalesce(steps, '') AS steps FROM p LEFT JOIN a USING (packet) LEFT JOIN s USING (packet)""",
    "margin_commits": """WITH e AS (SELECT user_id AS request, event_id AS subject, value, event_type IN ('click', 'purchase') AS fit, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events),
        t AS (SELECT * FROM e WHERE fit QUALIFY row_number() OVER (PARTITION BY request ORDER BY place) = 1), c AS (SELECT e.request, t.subject, t.value - max(e.value) FILTER (e.place <> t.place) AS margin FROM e LEFT JOIN t USING (request) GROUP BY e.request, t.subject, t.value)
        SELECT request, CASE WHEN margin >= 5 AND subject % 3 <> 0 THEN subject END AS committed, round(margin, 9) AS margin FROM c""",
    "tiered_candidates": """WITH c AS (SELECT event_id % 97 AS request, event_id AS subject, value, CASE WHEN value > 60 THEN 0 WHEN event_id + 97 IN (SELECT event_id FROM events WHERE event_type = 'error') THEN 1 ELSE 2 END AS tier FROM events),
        r AS (SELECT request, subject, tier, row_number() OVER (PARTITION BY request ORDER BY tier, value DESC, subject) AS place FROM c) SELECT * FROM r WHERE place <= 20""",
    "clarification_prompts": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events)
        SELECT user_id, 'Which subject did you mean: ' || string_agg(event_type || ' ' || event_id, ', ' ORDER BY place) || '?' AS prompt FROM r WHERE place <= 3 GROUP BY user_id""",
    "cohorts": """WITH f AS (SELECT event_type, user_id, min(event_id) AS first_at FROM events WHERE value > 20 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first_at, user_id) AS rank, count(*) OVER (PARTITION BY event_type) < 100 AS complete FROM f)
        SELECT event_type, user_id, rank, complete FROM r WHERE rank <= 100""",
    "missing_kinds": """WITH f AS (SELECT user_id, list(DISTINCT event_type) AS had FROM events GROUP BY user_id)
        SELECT user_id, array_to_string(list_filter(['click', 'signup', 'error', 'refund', 'purchase'], lambda k: NOT list_contains(had, k)), ',') AS missing FROM f""",
    "read_subjects": """SELECT o_custkey AS subject, 'root' AS origin FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT DISTINCT o_custkey, 'derived' FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "coarsest_grains": """SELECT user_id, CASE WHEN count(*) FILTER (event_type <> 'click' AND value > 45) > 0 THEN 'day' WHEN count(*) FILTER (event_type <> 'click') > 0 THEN 'instant' END AS grain FROM events GROUP BY user_id""",
    "edge_order": f"""{with_tables('work_graph_edges')}, c AS (SELECT source_id, edge_id, CASE WHEN confidence > 0.5 THEN confidence WHEN confidence * 20 <= 1 THEN confidence * 20 ELSE 1 / (confidence * 20) END AS sure FROM work_graph_edges)
        SELECT source_id, edge_id, row_number() OVER (PARTITION BY source_id ORDER BY sure DESC, edge_id) AS place, round(sure, 9) AS confidence FROM c""",
    "fact_bundle": f"""WITH f AS (SELECT o_orderkey % {DEALT} AS kind_ordinal, o_orderstatus AS subject_kind, o_orderkey::VARCHAR AS subject_id, o_orderpriority AS source FROM orders),
        r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY kind_ordinal ORDER BY subject_kind, subject_id, source) <= 200)
        SELECT ({list(FACT_KINDS[:DEALT])})[kind_ordinal + 1] AS fact_kind, subject_kind, subject_id, source, kind_ordinal FROM r ORDER BY kind_ordinal, subject_kind, subject_id, source LIMIT 2000""",
}
