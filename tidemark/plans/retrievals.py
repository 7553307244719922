"""Registered queries about retrieval: what is embedded, both arms of a search, promotion and the floor per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, search
from ..streaming.files import scratch

K, SIZE, FLOOR, IDENTITY = 10, 32, 0.4, "hashed-32"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def embed_targets(spark, sf_dir):
    """Nodes of three kinds of which runs are bare numbers in part, some without text, and told of several times."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "organization").when(F.col("event_type").isin("click", "error"), "ci_run").otherwise("work_item")
    label = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 700).cast("string")).otherwise(F.concat(F.lit("nightly build of "), F.col("event_type")))
    text = F.when(F.col("event_id") % 11 == 0, "   ").otherwise(F.concat(F.lit("  "), label, F.lit(" by user "), F.col("user_id").cast("string")))
    nodes = e.select(kind.alias("kind"), (F.col("event_id") % 700).cast("string").alias("node_id"), label.alias("label"), text.alias("text"), F.col("ts").alias("at"))
    return retrieval.embed_targets(nodes, 24)


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth part asks for its name, one in three for its brand too, one in four in the past, one in seven with nothing but marks."""
    p = _parts(spark, sf_dir).filter("p_partkey % 50 = 0")
    query = F.when(F.col("p_partkey") % 350 == 0, "?? !").when(F.col("p_partkey") % 150 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("query_id"), query.alias("query"), (F.col("p_partkey") % 200 == 50).alias("historical"), (F.col("p_partkey") % 250 != 100).alias("configured"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("node_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), "p_name", "p_brand")


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    subjects, asks = _subjects(spark, sf_dir), _asks(spark, sf_dir)
    table = retrieval.VectorTable(spark, scratch(spark, "vectors"), IDENTITY)
    embed = lambda text: retrieval.hashed_vector(text, SIZE)
    texts = subjects.select("text").unionByName(asks.filter("query_id % 450 <> 0").select(F.col("query").alias("text")))
    made = table.add(texts, embed)
    of = lambda df, text, key: df.select(key, F.sha2(text, 256).alias("text_hash"))
    return retrieval.hybrid_search(subjects, asks, made, of(asks, "query", "query_id").join(made, "text_hash").drop("text_hash"), K, FLOOR, of(subjects, "text", "node_id"))


def hybrid_candidates(spark, sf_dir):
    """Both arms merged per subject; vectors are made from words by a hash and kept in a table."""
    found, _ = _hybrid(spark, sf_dir)
    names = _subjects(spark, sf_dir).select("node_id", F.col("text").alias("name"), F.lit("label").alias("class"))
    merged = retrieval.mechanisms_of(retrieval.promoted(found, _asks(spark, sf_dir), names))
    return merged.select("query_id", "node_id", "reason", F.array_join("mechanisms", ",").alias("mechanisms"), F.round(search.corroborated(F.col("base"), F.col("mechanisms")), 9).alias("confidence"))


def search_degradation(spark, sf_dir):
    _, flags = _hybrid(spark, sf_dir)
    return flags.select("query_id", "degraded")


def promoted_candidates(spark, sf_dir):
    """The lexical arm with sure matches: every third part's label is its name, other names are aliases, brands are keys."""
    asks, subjects = _asks(spark, sf_dir), _subjects(spark, sf_dir)
    found = search.lexical_search_blocks(subjects, asks.select("query_id", "query"), "node_id", "text", K).select("query_id", "node_id", F.lit("lexical").alias("mechanism"), "relevance")
    names = subjects.select("node_id", F.upper("p_name").alias("name"), F.when(F.col("node_id") % 3 == 0, "label").otherwise("alias").alias("class"))
    names = names.unionByName(subjects.select("node_id", F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.lit("provider_key").alias("class")))
    out = retrieval.mechanisms_of(retrieval.promoted(found, asks, names))
    return out.select("query_id", "node_id", F.round("base", 9).alias("confidence"), "reason", F.array_join("mechanisms", ",").alias("mechanisms"))


def kind_floor_candidates(spark, sf_dir):
    """Kinds are sizes by tens; each asking part's pool holds its own kind only."""
    kind = F.concat(F.lit("size-"), F.floor(F.col("p_size") / 10).cast("string"))
    p = _parts(spark, sf_dir).withColumn("kind", kind)
    asks = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.array(F.lit("nothing"), F.split("p_name", " ")[1], F.split("p_name", " ")[0], F.lower("p_brand")).alias("terms"), "kind")
    index = search.inverted_index(p.withColumnsRenamed({"p_partkey": "node_id"}), "node_id", "p_name").join(p.select(F.col("p_partkey").alias("node_id"), "kind"), "node_id")
    kinds = tuple(f"size-{i}" for i in range(6))
    return retrieval.kind_floor(asks.select("query_id", "kind"), asks, index, kinds)


_TERMS = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[\s|&()\[\]{{}}~^*:\"''@%<>=!,;]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+', '')), lambda w: w <> ''))"
_ASKS = """asks AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 350 = 0 THEN '?? !' WHEN p_partkey % 150 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS query,
  p_partkey % 200 = 50 AS historical, p_partkey % 250 <> 100 AS configured FROM part WHERE p_partkey % 50 = 0)"""

STATEMENTS = {
    "embed_targets": """WITH n AS (
  SELECT CASE WHEN event_type = 'view' THEN 'organization' WHEN event_type IN ('click', 'error') THEN 'ci_run' ELSE 'work_item' END AS kind, (event_id % 700)::VARCHAR AS node_id,
    CASE WHEN event_id % 2 = 0 THEN (event_id % 700)::VARCHAR ELSE 'nightly build of ' || event_type END AS label,
    CASE WHEN event_id % 11 = 0 THEN '   ' ELSE '  ' || CASE WHEN event_id % 2 = 0 THEN (event_id % 700)::VARCHAR ELSE 'nightly build of ' || event_type END || ' by user ' || user_id END AS text, ts FROM events
), o AS (SELECT *, rtrim(substr(trim(text), 1, 24)) AS t FROM n QUALIFY row_number() OVER (PARTITION BY kind, node_id ORDER BY ts DESC, text) = 1),
d AS (SELECT *, CASE WHEN kind = 'organization' THEN 'skip' WHEN kind = 'ci_run' AND regexp_matches(label, '^[0-9]+$') THEN 'clear' WHEN t = '' THEN 'skip' ELSE 'embed' END AS decision FROM o)
SELECT kind, node_id, CASE WHEN decision = 'embed' THEN t END AS text, decision FROM d""",
    "search_degradation": f"""WITH {_ASKS} SELECT query_id, len({_TERMS.format("query")}) > 0 AND configured AND (historical OR query_id % 450 = 0 AND NOT EXISTS (
  SELECT 1 FROM asks b WHERE b.query = a.query AND b.query_id % 450 <> 0 UNION ALL SELECT 1 FROM part WHERE p_name || ' ' || p_brand = a.query)) AS degraded FROM asks a""",
    "promoted_candidates": f"""WITH {_ASKS}, t AS (SELECT query_id, query, unnest({_TERMS.format("query")}) AS term, len({_TERMS.format("query")}) AS terms FROM asks),
i AS (SELECT p_partkey AS node_id, unnest({_TERMS.format("p_name || ' ' || p_brand")}) AS term FROM part),
h AS (SELECT query_id, node_id, terms, count(*) AS matched FROM t JOIN i USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, node_id) AS place, count(*) OVER (PARTITION BY query_id) > 10 AS cut FROM h QUALIFY place <= 10),
f AS (SELECT query_id, node_id, CASE WHEN cut THEN 0.5 ELSE 0.5 + 0.25 * matched / terms END::DOUBLE AS relevance FROM r),
m AS (SELECT f.*, lower(trim(query)) = lower(p_name) AS by_name, lower(trim(query)) = lower(p_name || ' ' || p_brand) AS by_key, node_id % 3 = 0 AS labelled FROM f JOIN asks USING (query_id) JOIN part ON p_partkey = node_id)
SELECT query_id, node_id, round(CASE WHEN by_name AND labelled THEN 1.0::DOUBLE ELSE relevance END, 9) AS confidence,
  CASE WHEN by_name AND labelled THEN '{retrieval.EXACT_REASON}' WHEN by_name THEN '{retrieval.ALIAS_REASON}' WHEN by_key THEN '{retrieval.KEY_REASON}' ELSE '{retrieval.OTHER_REASON}' END AS reason,
  CASE WHEN by_name AND labelled THEN 'exact,lexical' WHEN by_name THEN 'alias,lexical' WHEN by_key THEN 'provider_key,lexical' ELSE 'lexical' END AS mechanisms FROM m""",
    "kind_floor_candidates": f"""WITH p AS (SELECT *, 'size-' || (p_size // 10) AS kind FROM part),
a AS (SELECT p_partkey AS query_id, kind, ['nothing', split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)] AS terms FROM p WHERE p_partkey % 50 = 0),
l AS (SELECT query_id, k.kind, unnest(terms) AS term, generate_subscripts(terms, 1) AS nth FROM a, (SELECT 'size-' || i AS kind FROM range(6) r(i)) k WHERE k.kind <> a.kind),
i AS (SELECT DISTINCT p_partkey AS node_id, kind, unnest({_TERMS.format("p_name")}) AS term FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY node_id) AS place FROM i QUALIFY place <= 5),
h AS (SELECT query_id, kind, nth, node_id, place FROM l JOIN f USING (term, kind))
SELECT query_id, kind, nth::INT AS term_place, node_id, place FROM h QUALIFY nth = min(nth) OVER (PARTITION BY query_id, kind)""",
}
QUERIES = (embed_targets, hybrid_candidates, search_degradation, promoted_candidates, kind_floor_candidates)
