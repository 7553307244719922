"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

BLOCK_ROWS = 8192
FAN_IN = 1024
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order, null last."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0


def source_targets(sizes: list[tuple[str | None, int]], mix: Mix) -> list[float]:
    """Each source's target: its weight's part of ``share`` times all sizes, at most
    ``most`` times its own size, the excess reshared by weight until none is above."""
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    caps = [mix.most * n for _, n in sizes]
    left, free, targets = mix.share * sum(n for _, n in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        above = {i for i in free if unit * weights[i] > caps[i]}
        for i in above or free:
            targets[i] = caps[i] if above else unit * weights[i]
        if not above:
            break
        left -= sum(caps[i] for i in above)
        free -= above
    return targets


def pivot(mass: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round chances to 0 or 1, keeping the sum of mass x chance but for one item.

    Two unfinished items trade words until one of them is integral; which way is drawn
    so that each chance is kept on average.  Returns the chances and the place of the
    item left unfinished, or -1.
    """
    out, held = chance.copy(), -1
    a = m = 0.0
    for i, (mi, ai, u) in enumerate(zip(mass.tolist(), chance.tolist(), draws.tolist(), strict=True)):
        if mi <= 0 or ai <= 0 or ai >= 1:
            out[i] = 1.0 if ai >= 1 else 0.0
            continue
        if held < 0:
            held, a, m = i, ai, mi
            continue
        give_held, give_new = min((1 - a) * m, ai * mi), min(a * m, (1 - ai) * mi)
        if u * (give_held + give_new) < give_new:
            held_full, new_empty = (1 - a) * m <= ai * mi, ai * mi <= (1 - a) * m
            a, ai = a + give_held / m, ai - give_held / mi
            a, ai = 1.0 if held_full else a, 0.0 if new_empty else ai
        else:
            held_empty, new_full = a * m <= (1 - ai) * mi, (1 - ai) * mi <= a * m
            a, ai = a - give_new / m, ai + give_new / mi
            a, ai = 0.0 if held_empty else a, 1.0 if new_full else ai
        if a in (0.0, 1.0):
            out[held] = a
            held, a, m = (-1, 0.0, 0.0) if ai in (0.0, 1.0) else (i, ai, mi)
        if ai in (0.0, 1.0):
            out[i] = ai
    if held >= 0:
        out[held] = a
    return out, held


def _rounded(frame: pd.DataFrame, level: int, final: bool) -> pd.DataFrame:
    frame = frame.sort_values(["size", "doc_id", "row_key", "block"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    key = f"{SEED}:{level}:{frame.source_no[0]}:{frame.parent[0]}"
    draws = np.random.Generator(np.random.Philox(zlib.crc32(key.encode()))).random(len(frame) + 1)
    chance, held = pivot(frame["size"].to_numpy(np.float64), frame.chance.to_numpy(np.float64), draws[:-1])
    if held >= 0 and final:
        chance[held], held = float(draws[-1] < chance[held]), -1
    return frame.assign(chance=chance, open=np.arange(len(frame)) == held)


def _level(rows: DataFrame, level: int, final: bool) -> DataFrame:
    schema = T.StructType([f for f in rows.schema.fields if f.name != "open"] + [T.StructField("open", T.BooleanType())])
    names = schema.fieldNames()
    return rows.groupBy("source_no", "parent").applyInPandas(lambda p: _rounded(p, level, final)[names], schema)


def _row_key(docs: DataFrame, key: str, text: str) -> Column:
    """Equal for rows that are equal in key and text, and for hardly any others."""
    return F.xxhash64(docs[key].cast("long"), F.lit("text"), docs[text].cast("string"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    A document of a source with target / size = c is taken floor(c) or floor(c) + 1
    times.  Within a block of a source, documents from large to small trade fractions
    of a copy until at most one is unfinished; the unfinished ones of many blocks meet
    at the next level of a tree, and the last one is drawn.  So a source's words miss
    its target by one document at most.  Null text: size 0, taken 0.  A null source is
    a source of its own, after all others.  Repeated rows are separate documents.
    Other columns are ignored; an empty table gives an empty result.
    """
    return _decided(docs, mix, key, text, source).drop("row_key")


def _decided(docs: DataFrame, mix: Mix, key: str, text: str, source: str) -> DataFrame:
    """``mix_sources`` with each row's ``row_key``."""
    spark = docs.sparkSession
    space = Workspace(spark, "mix")
    sized = docs.select(
        docs[key].cast("long").alias("doc_id"),
        _row_key(docs, key, text).alias("row_key"),
        docs[source].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = space.write(sized, "sized")
    # One row a source comes to the driver: its total, from partial sums.
    totals = sorted(((r[0], r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    targets = source_targets([(s, n) for s, n, _ in totals], mix)
    plan, most_blocks = [], 1
    for no, ((name, size, rows), target) in enumerate(zip(totals, targets, strict=True)):
        copies = min(target / size, mix.most) if size else 0.0
        blocks = -(-rows // BLOCK_ROWS)
        most_blocks = max(most_blocks, blocks)
        plan.append((no, name, size, target, int(copies), copies - int(copies), blocks))
    plans = spark.createDataFrame(plan, "source_no int, of string, source_size long, target double, whole int, chance double, blocks int")
    rows = sized.join(plans, sized["source"].eqNullSafe(plans["of"])).select(
        "doc_id", "row_key", "size", "source_no", "source_size", "target", "whole", "chance",
        F.pmod("row_key", F.col("blocks")).alias("block"),
    )
    first = space.write(_level(rows.withColumn("parent", F.col("block")), 0, most_blocks == 1), "level0")
    done, waiting, level, blocks = None, first.filter("open"), 0, most_blocks
    while blocks > 1:
        level, blocks = level + 1, -(-blocks // FAN_IN)
        step = _level(waiting.withColumn("parent", F.floor(F.col("parent") / FAN_IN)), level, blocks == 1)
        step = space.write(step, f"level{level}")
        closed = step.filter(~F.col("open")).select(F.col("source_no").alias("_no"), F.col("block").alias("_block"), F.col("chance").alias("_chance"))
        done = closed if done is None else done.unionByName(closed)
        waiting = step.filter("open")
    if done is None:
        decided = first.withColumn("extra", F.col("chance"))
    else:
        closed = first.filter(~F.col("open")).withColumn("extra", F.col("chance"))
        late = first.filter("open").join(done, (F.col("source_no") == F.col("_no")) & (F.col("block") == F.col("_block"))).withColumn("extra", F.col("_chance")).drop("_no", "_block", "_chance")
        decided = closed.unionByName(late)
    copies = F.col("whole") + F.col("extra").cast("int")
    return decided.select("doc_id", "row_key", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents without words go.

    Rows equal in key and text get the copies of all of them together, one more for the
    first ones where these can't be shared evenly.
    """
    decided = _decided(docs, mix, key, text, source).filter("size > 0")
    taken = decided.groupBy("row_key").agg(F.min("copies").alias("_mix_least"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_mix_more"))
    rows = docs.select("*", _row_key(docs, key, text).alias("_mix_key"))
    joined = rows.join(taken.filter("_mix_least + _mix_more > 0"), rows["_mix_key"] == taken["row_key"])
    nth = F.row_number().over(Window.partitionBy("_mix_key").orderBy(source))
    copies = F.col("_mix_least") + F.when(nth <= F.col("_mix_more"), 1).otherwise(0)
    joined = joined.withColumn("_mix_copies", copies).filter("_mix_copies > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)
