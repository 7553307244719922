"""Retrieval for subject resolution: what is embedded, a kept table of vectors, two-armed search, promotion and a floor per kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_text, is_pure_identifier
from ..streaming.files import stored
from .search import lexical_search_blocks, nearest_blocks, query_terms, vector_relevance

#: Kinds that are never embedded, the kind whose bare identifiers are not, and the search for a missing kind.
NOT_EMBEDDED, IDENTIFIER_KIND = ("organization",), "ci_run"
FLOOR_TERMS, FLOOR_RESULTS = 3, 5
#: Why a candidate matched.
EXACT_REASON, ALIAS_REASON, KEY_REASON = "Exact canonical subject label match.", "Repository/project alias matched.", "Provider-qualified identifier matched."
OTHER_REASON = "Hybrid graph search matched the subject label or indexed context."


def embed_targets(nodes: DataFrame, most_chars: int) -> DataFrame:
    """(kind, node_id, text, decision) of each node: embed, clear (an identifier whose vector must go) or skip.

    nodes: kind, node_id, label, text, at.  The last row of a node counts; white space around a text goes,
    and it is cut to ``most_chars``; a node without text or id has nothing to embed.
    """
    last = Window.partitionBy("kind", "node_id").orderBy(F.desc_nulls_last("at"), "text")
    once = nodes.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    text = bounded_text(F.coalesce("text", F.lit("")), most_chars)
    decision = (
        F.when(F.col("kind").isin(*NOT_EMBEDDED), "skip").when((F.col("kind") == IDENTIFIER_KIND) & F.coalesce(is_pure_identifier(F.col("label")), F.lit(False)), "clear")
        .when((text == "") | (F.trim(F.coalesce("node_id", F.lit(""))) == ""), "skip").otherwise("embed")
    )
    return once.select("kind", "node_id", F.when(decision == "embed", text).alias("text"), decision.alias("decision"))


class VectorTable:
    """Vectors by the hash of their text and the identity of what made them, added to and never made twice.

    Rows of an identity are read for no other; a text that many nodes share is embedded once.
    An addition is one append of the rows that are missing, so a repeated one adds none.
    """

    def __init__(self, spark: SparkSession, root: str, identity: str) -> None:
        self.spark, self.identity, self.path = spark, identity, f"{root.rstrip('/')}/vectors"

    def read(self) -> DataFrame:
        schema = "identity string, text_hash string, vector array<double>"
        try:
            stored = self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # nothing was added yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = self.spark.createDataFrame([], schema)
        mine = stored.filter(F.col("identity") == self.identity)
        return mine.groupBy("text_hash").agg(F.min("vector").alias("vector"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """(text_hash, text) of distinct texts that have no vector of this identity."""
        asked = texts.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash"), "text").groupBy("text_hash").agg(F.min("text").alias("text"))
        return asked.join(self.read().select("text_hash"), "text_hash", "left_anti")

    def add(self, texts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
        """Embed what is missing and return (text_hash, vector) of all ``texts``."""
        fresh = self.missing(texts).select(F.lit(self.identity).alias("identity"), "text_hash", embed(F.col("text")).alias("vector"))
        fresh.filter("vector IS NOT NULL").write.mode("append").parquet(self.path)
        return texts.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash")).distinct().join(self.read(), "text_hash")


def hashed_vector(text: Column, size: int) -> Column:
    """Counts of a text's words by a hash, with signs: a vector that every engine can make.  Null without words."""
    words = query_terms(text)
    code = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
    signed = F.transform(words, lambda w: F.struct((code(w) % size).alias("at"), F.when(F.floor(code(w) / size) % 2 == 0, 1.0).otherwise(-1.0).alias("by")))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(signed, lambda s: s["at"] == i), F.lit(0.0), lambda a, s: a + s["by"]))
    return F.when(F.size(words) > 0, vector)


def hybrid_search(subjects: DataFrame, asks: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, k: int, floor: float, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both arms of a search and what each request lacked.

    subjects: node_id, text; asks: query_id, query, historical, configured; vectors: node_id,
    vector, or text_hash, vector with ``texts``: node_id, text_hash; asked_vectors: query_id,
    vector.  Returns (query_id, node_id, mechanism, relevance) of both arms, not yet merged,
    and (query_id, truncated, degraded) of every request.

    A request without any word asks neither arm.  Vectors have no history, so the vector arm
    is left out of a historical request, which is degraded, as is one that has no vector of
    its own; one for which none is configured expects none and is not.
    """
    terms = F.size(query_terms(F.coalesce("query", F.lit(""))))
    worded = asks.filter(terms > 0)
    lexical = lexical_search_blocks(subjects, worded.select("query_id", "query"), "node_id", "text", k)
    able = worded.filter("configured AND NOT historical").join(asked_vectors, "query_id").select("query_id", "vector")
    near = nearest_blocks(vectors, able, "node_id", "vector", "query_id", k + 1, floor, texts)
    cut = near.groupBy("query_id").agg((F.max("place") > k).alias("_near_cut"))
    near = near.filter(F.col("place") <= k)
    found = lexical.select("query_id", "node_id", F.lit("lexical").alias("mechanism"), "relevance").unionByName(
        near.select("query_id", F.col("hit_id").alias("node_id"), F.lit("vector").alias("mechanism"), vector_relevance(F.col("similarity"), floor).alias("relevance"))
    )
    flags = asks.select("query_id", (terms > 0).alias("_worded"), "configured", "historical").join(asked_vectors.select("query_id", F.lit(True).alias("_has")), "query_id", "left")
    flags = flags.join(lexical.groupBy("query_id").agg(F.bool_or("truncated").alias("_cut")), "query_id", "left").join(cut, "query_id", "left")
    degraded = F.col("_worded") & F.col("configured") & (F.col("historical") | F.col("_has").isNull())
    truncated = F.coalesce("_cut", F.lit(False)) | F.coalesce("_near_cut", F.lit(False))
    return found, flags.select("query_id", truncated.alias("truncated"), degraded.alias("degraded"))


def promoted(found: DataFrame, asks: DataFrame, names: DataFrame, allow_exact: bool = True) -> DataFrame:
    """Candidates with their sure matches: confidence, the reason that counts, and all mechanisms.

    found: query_id, node_id, mechanism, relevance (null counts as 0.5); names: node_id, name,
    class (label, alias, provider_key).  In order: the label is what was asked for, which makes
    a candidate sure; an alias is; a provider's key is.  Each step sees only what the ones
    before have left, and a match on an alias or key adds its mechanism and no confidence.
    What was asked meets the names of the nodes that were found for it, never all its namesakes.
    """
    folded = lambda c: F.lower(F.trim(c))
    found = stored(found, "found")
    rank = F.min(F.when(F.col("class") == "label", 0).when(F.col("class") == "alias", 1).otherwise(2))
    named = names.groupBy("node_id", folded(F.col("name")).alias("_name")).agg(rank.alias("_class"))
    pairs = found.select("query_id", "node_id").distinct().join(asks.select("query_id", folded(F.col("query")).alias("_name")), "query_id")
    sure = pairs.join(named, ["node_id", "_name"]).groupBy("query_id", "node_id").agg(F.min("_class").alias("_class"))
    out = found.join(sure, ["query_id", "node_id"], "left")
    cls = F.col("_class") if allow_exact else F.lit(None).cast("int")
    by = F.col("mechanism")
    reason = F.when(cls == 0, EXACT_REASON).when((cls == 1) | (cls.isNull() & (by == "alias")), ALIAS_REASON).when((cls == 2) | (cls.isNull() & (by == "provider_key")), KEY_REASON).otherwise(OTHER_REASON)
    added = F.when(cls == 0, "exact").when(cls == 1, "alias").when(cls == 2, "provider_key")
    confidence = F.when(cls == 0, 1.0).otherwise(F.when(F.coalesce("relevance", F.lit(0.0)) == 0, 0.5).otherwise(F.col("relevance")))
    return out.select("query_id", "node_id", F.explode(F.array_compact(F.array(by, added))).alias("mechanism"), confidence.alias("confidence"), reason.alias("reason"))


def kind_floor(pool: DataFrame, asks: DataFrame, index: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Candidates of kinds that a request's pool has none of: (query_id, kind, term_place, node_id, place).

    pool: query_id, kind; asks: query_id, terms (array, in order); index: term, kind, node_id.
    Each of the first three terms is looked up among nodes of the kind, five results each; the
    first term that finds any ends the search for that kind.
    """
    every = asks.select("query_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.slice("terms", 1, FLOOR_TERMS).alias("terms"))
    lacking = every.join(pool.select("query_id", "kind").distinct(), ["query_id", "kind"], "left_anti")
    looked = lacking.select("query_id", "kind", F.posexplode("terms").alias("_at", "term"))
    near = Window.partitionBy("term", "kind").orderBy("node_id")
    first = index.select("term", "kind", "node_id").distinct().withColumn("place", F.row_number().over(near)).filter(F.col("place") <= FLOOR_RESULTS)
    hits = looked.join(first, ["term", "kind"])
    best = hits.groupBy("query_id", "kind").agg(F.min("_at").alias("_at"))
    return hits.join(best, ["query_id", "kind", "_at"]).select("query_id", "kind", (F.col("_at") + 1).alias("term_place"), "node_id", "place")


def mechanisms_of(found: DataFrame) -> DataFrame:
    """One row per request and node: the surest confidence, its reason, and mechanisms in their fixed order."""
    from ..functions.vocabulary import MECHANISMS

    order = reduce(lambda c, i: c.when(F.col("mechanism") == MECHANISMS[i], i), range(1, len(MECHANISMS)), F.when(F.col("mechanism") == MECHANISMS[0], 0))
    return found.groupBy("query_id", "node_id").agg(
        F.max("confidence").alias("base"), F.max_by("reason", F.struct("confidence", -order)).alias("reason"), F.array_intersect(F.lit(list(MECHANISMS)), F.collect_set("mechanism")).alias("mechanisms"),
    )
