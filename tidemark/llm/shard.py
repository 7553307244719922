"""Sharding by weighted rendezvous hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import gapless_rank
from .workspace import Workspace

ROWS_PER_SPREAD = 50_000


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard whose score for the key is least: -ln(u) / weight, u from md5(key:shard).

    Scores of a shard do not depend on the other shards, so a new shard takes rows
    only into itself and a removed one gives away only its own.  Ties go to the
    smaller shard.  A null key counts as the empty string.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(2**52)
        scores.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16; a null text has none, and crc32 0.  Equal
    keys (repeated rows, null keys) share a shard.  slot: 0, 1, 2 ... in each shard by
    md5(key), key, crc32 and size, rows without a key after those whose md5 begins alike; rows
    equal in all of these may swap slots.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    grown = grown if grown is not None else [*weights, weights[-1]]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), grown).alias("grown_shard"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_digest"),
    )
    stored = Workspace(spark, "shard").write(rows, "rows")
    per_shard = stored.count() / len(weights)
    digits = max(0, math.ceil(math.log(max(1.0, per_shard / ROWS_PER_SPREAD), 16)))
    prefix = F.substring("_digest", 1, digits)
    # rows without a key share a digest; their texts' checksums spread them
    spread = F.when(F.col("doc_id").isNull(), F.concat(prefix, F.lpad(F.substring(F.lower(F.hex("text_crc32")), 1, digits), digits, "0"))).otherwise(prefix)
    ranked = gapless_rank(stored, ["shard"], spread, ["_digest", "doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
