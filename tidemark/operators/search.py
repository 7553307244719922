"""Lexical and vector search, score fusion, commit gates, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import MECHANISMS
from ..streaming.files import stored
from .ranks import values_at_ranks

#: Bounds of the lexical, vector and corroborated scores, and of the gates.
LEXICAL_BASE, LEXICAL_SPAN = 0.50, 0.25
VECTOR_BASE, VECTOR_SPAN = 0.50, 0.20
JOINT_BASE, JOINT_SPAN = 0.72, 0.14
LONE_FLOOR, TOP_FLOOR, TOP_GAP = 0.72, 0.88, 0.12
PARENT_DISCOUNT = 0.85
#: Rows and queries that meet in one task, and terms compared at once.
CHUNK_ROWS, BLOCK_QUERIES, TERMS_AT_ONCE = 4096, 1024, 2048


def query_terms(text: Column) -> Column:
    """Words of a query: split at operators and blanks, leading marks stripped, distinct, lower case."""
    parts = F.split(F.lower(text), r"[\s|&()\[\]{}~^*:\"'@%<>=!,;]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+", "")), lambda w: w != ""))


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key), one row per distinct term of a text."""
    return docs.select(key, F.explode(query_terms(F.col(text))).alias("term"))


def lexical_search(index: DataFrame, queries: DataFrame, key: str, k: int, query: str = "query_id", text: str = "query") -> DataFrame:
    """The k best by how many of a query's terms a text has; relevance 0.50 to 0.75, the floor where more than k matched."""
    terms = queries.select(query, F.explode(query_terms(F.col(text))).alias("term"), F.size(query_terms(F.col(text))).alias("terms"))
    hits = index.join(terms, "term").groupBy(query, key, "terms").agg(F.count("*").alias("matched"))
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("matched"), key)))
    ranked = ranked.withColumn("truncated", F.count("*").over(Window.partitionBy(query)) > k).filter(F.col("place") <= k)
    relevance = F.when(F.col("truncated"), LEXICAL_BASE).otherwise(LEXICAL_BASE + LEXICAL_SPAN * F.col("matched") / F.col("terms"))
    return ranked.withColumn("relevance", relevance)


def _in_blocks(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, work: Callable, schema: str) -> DataFrame:
    """Every block of queries meets every chunk of rows in a task of its own; both have a bounded size."""
    chunks, blocks = (max(1, math.ceil(df.count() / n)) for df, n in ((rows, CHUNK_ROWS), (queries, BLOCK_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("_chunk", at(row_id, chunks)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", at(query_id, blocks)).withColumn("_chunk", every(chunks))
    return left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInPandas(work, schema)


def _classes(rows: DataFrame, row_id: str, value: str, k: int) -> DataFrame:
    """(value, _n, _ids): each different value with the number of its rows and their k least ids, stored."""
    counted = rows.groupBy(value).agg(F.count("*").alias("_n"))
    return stored(_least(rows, row_id, value, k).join(counted, value), "classes")


def _least(rows: DataFrame, row_id: str, value: str, k: int) -> DataFrame:
    first = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(value).orderBy(row_id))).filter(F.col("_nth") <= k)
    return first.groupBy(value).agg(F.collect_list(row_id).alias("_ids"))


def _united(classes: DataFrame, value: str, k: int) -> DataFrame:
    """Classes of another value than they were made by: those that are equal in it are one, stored."""
    counted = classes.groupBy(value).agg(F.sum("_n").alias("_n"))
    return stored(_least(classes.select(value, F.explode("_ids").alias("_id")), "_id", value, k).join(counted, value), "united")


def lexical_search_blocks(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int, query: str = "query_id", asked: str = "query") -> DataFrame:
    """``lexical_search`` for many queries: only k rows per query and chunk of texts are shuffled, not every match.

    Ids on both sides are unique and not null.  Texts of the same words are one class, with their
    number and k least ids, and so are queries: what is compared grows with different texts only.
    Equal texts are counted before they are cut into words, which is done once for each.
    """
    worded = lambda df, c: df.withColumn("_words", F.array_sort(query_terms(F.col(c)))).filter(F.size("_words") > 0).drop(c)
    texts = _classes(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text IS NOT NULL"), "_key", "_text", k)
    rows = _united(worded(texts, "_text"), "_words", k)
    members = worded(queries.select(query, F.col(asked).alias("_asked")), "_asked")
    terms = stored(members.groupBy("_words").agg(F.min(query).alias("_query")), "asked")
    at_once = TERMS_AT_ONCE

    def work(found: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        found, sought, out = found.reset_index(drop=True), sought.reset_index(drop=True), []
        of_query, of_row = sought["_words"].explode().dropna(), found["_words"].explode().dropna()
        known = pd.Index(of_query.unique())
        row_code, query_code = known.get_indexer(of_row), known.get_indexer(of_query)
        matched = np.zeros((len(sought), len(found)), np.float32)
        for low in range(0, len(known), at_once):
            sides = []
            for code, at, n in ((query_code, of_query.index.to_numpy(), len(sought)), (row_code, of_row.index.to_numpy(), len(found))):
                inside = (code >= low) & (code < low + at_once)
                side = np.zeros((n, min(at_once, len(known) - low)), np.float32)
                side[at[inside], code[inside] - low] = 1
                sides.append(side)
            matched += sides[0] @ sides[1].T
        size, number, ids = sought["_words"].str.len().to_numpy(), found["_n"].to_numpy(), found["_ids"].to_numpy()
        for i, one in enumerate(matched):
            hits = np.flatnonzero(one)
            best, n = [], 0
            for level in np.unique(one[hits])[::-1]:
                if n >= k:
                    break
                same = np.sort(np.concatenate([ids[j] for j in hits[one[hits] == level]]))[: k - n]
                best.append((same, np.full(len(same), int(level), np.int64)))
                n += len(same)
            if n:
                here = np.zeros(n, np.int64)
                here[0] = number[hits].sum()
                out.append(pd.DataFrame({"_query": sought["_query"].iloc[i], key: np.concatenate([b[0] for b in best]), "terms": size[i], "matched": np.concatenate([b[1] for b in best]), "_here": here}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("_query", key, "terms", "matched", "_here")})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    hits = _in_blocks(rows, terms, "_words", "_query", work, f"_query {kind(queries, query)}, {key} {kind(docs, key)}, terms int, matched long, _here long")
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("matched"), key)))
    ranked = ranked.withColumn("truncated", F.sum("_here").over(Window.partitionBy("_query")) > k).filter(F.col("place") <= k).drop("_here")
    ranked = ranked.withColumn("relevance", F.when(F.col("truncated"), LEXICAL_BASE).otherwise(LEXICAL_BASE + LEXICAL_SPAN * F.col("matched") / F.col("terms")))
    return members.join(terms, "_words").drop("_words").join(ranked, "_query").drop("_query")


def expand_terms(terms: DataFrame, lexicon: DataFrame, found: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Matches of synonyms, appended only where the plain search has not found the text."""
    synonyms = terms.join(lexicon, "term").select("query_id", F.col("synonym").alias("term")).distinct()
    return index.join(synonyms, "term").select("query_id", key).distinct().join(found.select("query_id", key), ["query_id", key], "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int, floor: float = -1.0) -> DataFrame:
    """Exact k nearest by cosine strictly above the floor, ties by key.

    ``queries`` is a stated query set, sent to every task once its size is known to be
    small; the vectors are scanned once and only k rows per query and task travel.
    """
    q = queries.select(F.col(query).alias("query_id"), F.col(vector).alias("_q"))
    scored = vectors.select(F.col(key).alias("hit_id"), F.col(vector).alias("_v")).join(q, F.col("hit_id") != F.col("query_id"))
    scored = scored.select("query_id", "hit_id", cosine(F.col("_v"), F.col("_q")).alias("similarity")).filter(F.col("similarity") > floor)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def nearest_blocks(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int, floor: float = -1.0, texts: DataFrame | None = None) -> DataFrame:
    """``nearest`` for many queries: exact, scored block by block, k rows per query and chunk of vectors shuffled.

    Ids on both sides are unique and not null.  Vectors that are null, zero or hold
    null or non-finite components have no similarity, nor have vectors of different lengths.
    Equal vectors are one class on either side, with the k + 1 least ids of its rows: one of
    them may be the query itself.  With ``texts`` (key, text_hash) vectors are those of texts
    (text_hash, vector), which meet classes of rows and not each row.
    """

    def usable(df: DataFrame, name: str) -> DataFrame:
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.filter(finite & F.exists(vector, lambda x: x != 0)).select(F.col(name).alias(f"_{name}_id"), F.col(vector).cast("array<double>").alias("_v"))

    def units(frame: pd.DataFrame) -> np.ndarray:
        raw = np.stack(frame["_v"].to_numpy())
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        return raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))

    def work(found: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        out = []
        found, sought = (f.assign(_n=f["_v"].str.len()) for f in (found, sought))
        for n, some in sought.groupby("_n"):
            near = found[found["_n"] == n]
            if not len(near):
                continue
            x, y, ids = units(near), units(some), near["_ids"].to_numpy()
            for q, one, rough in zip(some["_query"].to_numpy(), y, y @ x.T, strict=True):
                # Products of whole matrices differ in the last bits by place; ties are decided on sums of one order.
                least = np.partition(rough, -k - 1)[-k - 1] if len(rough) > k + 1 else -np.inf
                near_k = np.flatnonzero((rough >= least - 1e-12) & (rough > floor - 1e-12))
                exact = (x[near_k] * one).sum(axis=1)
                near_k, exact = near_k[exact > floor], exact[exact > floor]
                if not len(near_k):
                    continue
                hit_id, exact = np.concatenate(ids[near_k]), np.repeat(exact, [len(i) for i in ids[near_k]])
                by_id = np.argsort(hit_id, kind="stable")
                best = by_id[np.argsort(-exact[by_id], kind="stable")][: k + 1]
                out.append(pd.DataFrame({"_query": q, "hit_id": hit_id[best], "similarity": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("_query", "hit_id", "similarity")})

    made_of = key if texts is None else "text_hash"
    rows, members = (usable(df, name).withColumnRenamed(f"_{name}_id", to) for df, name, to in ((vectors, made_of, "_row"), (queries, query, "query_id")))
    if texts is None:
        classes = _classes(rows, "_row", "_v", k + 1)
    else:
        copies = _classes(texts.select(F.col(key).alias("_id"), F.col("text_hash").alias("_row")), "_id", "_row", k + 1)
        classes = _united(copies.join(rows, "_row").drop("_row"), "_v", k + 1)
    asked = stored(members.groupBy("_v").agg(F.min("query_id").alias("_query")), "asked")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    scored = _in_blocks(classes, asked, "_v", "_query", work, f"_query {kind(queries, query)}, hit_id {kind(vectors if texts is None else texts, key)}, similarity double")
    best = Window.partitionBy("_query").orderBy(F.desc("similarity"), "hit_id")
    few = scored.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k + 1).drop("_nth")
    own = members.join(asked, "_v").drop("_v").join(few, "_query").drop("_query").filter(F.col("hit_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id"))
    return own.withColumn("place", place).filter(F.col("place") <= k)


def vector_relevance(similarity: Column, floor: float) -> Column:
    return F.lit(VECTOR_BASE) if floor >= 1 else VECTOR_BASE + VECTOR_SPAN * (similarity - floor) / (1 - floor)


def similarity_of(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def result_confidence(relevance: Column, score: Column) -> Column:
    """The relevance, else a score within 0 and 1, else its inverse."""
    return F.coalesce(relevance, F.when(score.between(0, 1), score).when(score > 1, 1 / score))


def corroborated(base: Column, mechanisms: Column) -> Column:
    """Two or more mechanisms lift a score to 0.72 and up to 0.86; a sure one stays 1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    n = F.size(mechanisms)
    joint = F.greatest(base, JOINT_BASE + JOINT_SPAN * unit(0.5 * base + 0.5 * unit((n - 2) / 4)))
    return F.when(base >= 1, 1.0).when(n >= 2, joint).otherwise(base)


def merge_candidates(found: DataFrame, group: list[str], subject: str) -> DataFrame:
    """One row per subject: the surest find, all terms, the mechanisms in their fixed order."""
    merged = found.groupBy(*group, subject).agg(
        F.max("confidence").alias("base"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
        F.array_intersect(F.lit(list(MECHANISMS)), F.collect_set("mechanism")).alias("mechanisms"),
    )
    return merged.withColumn("confidence", corroborated(F.col("base"), F.col("mechanisms")))


def lift_to_parents(candidates: DataFrame, attributions: DataFrame, group: list[str], subject: str, parent: str) -> DataFrame:
    """Observations pass their confidence, discounted, to what they belong to; outcome: lifted, ambiguous or absent."""
    counts = attributions.groupBy(subject).agg(F.count_distinct(parent).alias("parents"), F.min(parent).alias(parent))
    out = candidates.join(counts, subject, "left")
    outcome = F.when(F.col("parents").isNull(), "absent").when(F.col("parents") > 1, "ambiguous").otherwise("lifted")
    return out.select(*group, subject, F.when(outcome == "lifted", F.col(parent)).alias(parent), outcome.alias("outcome"), F.when(outcome == "lifted", F.col("confidence") * PARENT_DISCOUNT).alias("confidence"))


def commit_gate(candidates: DataFrame, group: list[str], subject: str, eligible: Column, truncated: Column) -> DataFrame:
    """Per request: commit to the top subject or not, and why.

    A truncated search never commits; a lone candidate needs 0.72; the top one needs
    0.88 and a lead of 0.12 over the next, eligible or not.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("confidence"), subject)
    ranked = candidates.withColumn("_eligible", eligible).withColumn("_truncated", truncated).withColumn("_place", F.row_number().over(w))
    top = ranked.filter("_place <= 2").groupBy(*group).agg(
        F.max(F.when(F.col("_place") == 1, F.struct(F.col(subject), "confidence", "_eligible"))).alias("first"),
        F.max(F.when(F.col("_place") == 2, F.col("confidence"))).alias("second"),
        F.max("_truncated").alias("cut"),
    )
    best, gap = F.col("first.confidence"), F.col("first.confidence") - F.col("second")
    outcome = (
        F.when(F.col("cut"), "ambiguous")
        .when(~F.col("first._eligible"), "ambiguous")
        .when(F.col("second").isNull(), F.when(best >= LONE_FLOOR, "commit").otherwise("ambiguous"))
        .when(F.col("second") == best, "tied")
        .when((best >= TOP_FLOOR) & (gap >= TOP_GAP - 1e-12), "commit")
        .otherwise("ambiguous")
    )
    return top.select(*group, outcome.alias("outcome"), F.when(outcome == "commit", F.col(f"first.{subject}")).alias("committed"), best.alias("confidence"), gap.alias("gap"))


def identity_claims(names: DataFrame, term: str, subject: str, cls: str) -> DataFrame:
    """Per term: its claimants and, if one label or alias class has exactly one, who it names."""
    by_class = names.groupBy(term, cls).agg(F.count_distinct(subject).alias("claimants"), F.min(subject).alias("only"))
    return by_class.groupBy(term).agg(
        F.max("claimants").alias("most_claimants"),
        F.min_by(F.when(F.col("claimants") == 1, F.col("only")), F.struct((F.col("claimants") != 1), F.col(cls))).alias("names"),
        (F.max("claimants") > 1).alias("collides"),
        (F.count_distinct(F.when(F.col("claimants") == 1, F.col("only"))) > 1).alias("rivals"),
    )


def calibrate_floor(samples: DataFrame, similarity: str, recall: float) -> DataFrame:
    """The greatest floor that keeps the target share of correct similarities, as ``>=`` on a sample,
    and the share it keeps.  At least one sample stays."""
    some = samples.filter(F.col(similarity).isNotNull()).select(similarity)
    # the smallest number of rows that is the target share of all; a rounded product may be one off
    least = lambda n: F.least(n, F.greatest(F.lit(1), F.when((F.ceil(n * recall) - 1) / n >= recall, F.ceil(n * recall) - 1).otherwise(F.ceil(n * recall))))
    at = values_at_ranks(some.withColumn("_one", F.lit(1)), ["_one"], similarity, {"floor": lambda n: n - least(n)}).select("floor")
    kept = some.join(at).groupBy("floor").agg((F.count_if(F.col(similarity) >= F.col("floor")) / F.count("*")).alias("kept"))
    return kept.agg(F.max("floor").alias("floor"), F.max("kept").alias("kept"))


def over_fetch(near_duplicates: int, k: int) -> int:
    return max(1, math.ceil((k + near_duplicates) / k))


def margin_threshold(samples: DataFrame, margin: str, correct: str) -> DataFrame:
    """Margins above every wrong one: the largest wrong margin, and the share of correct ones beyond it."""
    wrong = samples.agg(F.max(F.when(~F.col(correct), F.col(margin))).alias("largest_wrong"))
    return samples.join(wrong).groupBy("largest_wrong").agg((F.count_if(F.col(correct) & (F.col(margin) > F.col("largest_wrong"))) / F.nullif(F.count_if(F.col(correct)), F.lit(0))).alias("reach"))
