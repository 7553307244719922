"""Quota windows that begin with a request and restart with the first request after they expire.

Where a window begins depends on all windows before it.  Times are cut into slots as long as a
window, so a slot holds at most one begin, and slots into blocks.  A task of a block finds,
from each request of its first slot, at what time the chain leaves the block; one pass over
these few requests per key links the blocks; then the tasks mark the begins.  Requests are
reduced to distinct times first, and blocks are made so short that a task's share is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct times that a block's task holds, where a single slot does not hold more.
TIMES_PER_BLOCK = 1_000_000
#: Distinct times of many keys that a task takes at once, where a block of one key does not hold more.
TIMES_PER_BUCKET = 50_000


def _exits(t: np.ndarray, first_end: int, width: int, block_end: int) -> np.ndarray:
    """From each time of the first slot: when the last window that begins in the block expires."""
    after = np.searchsorted(t, t + width)
    out = t + width
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            out[i] = out[after[i]]
    return out[: np.searchsorted(t, first_end)]


def window_starts(times: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, at, start) of distinct times ``at`` in whole microseconds, for windows of ``width`` microseconds.

    The first time of a key begins a window; a window ends ``width`` later, exclusively.
    """
    slot = F.floor(F.col("at") / width)
    slots = times.groupBy(*key, slot.alias("_slot")).agg(F.count("*").alias("n"))
    largest, every = slots.agg(F.max("n"), F.sum("n")).first()
    per_block = int(max(1, TIMES_PER_BLOCK // (largest or 1)))
    buckets = max(1, -(-(every or 0) // TIMES_PER_BUCKET))
    blocked = times.withColumn("_block", F.floor(slot / per_block)).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    kinds = dict(times.dtypes)
    names = ", ".join(f"{k} {kinds[k]}" for k in key)

    def by_key(frame: pd.DataFrame) -> Iterator[tuple[int, int]]:
        """Where each key's rows begin and end in a frame that is sorted by key."""
        fresh = np.zeros(len(frame), bool)
        fresh[:1] = True
        for k in key:
            values = frame[k].to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(fresh)
        return zip(at, [*at[1:], len(frame)], strict=True)

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        """Entries of a block: each time of a key's first slot, and the first time after that."""
        frame = frame.sort_values([*key, "at"], ignore_index=True)
        every_t, block = frame["at"].to_numpy(), int(frame["_block"].iloc[0])
        first_end = (block * per_block + 1) * width
        rows, enter, leaves = [], [], []
        for a, b in by_key(frame):
            t = every_t[a:b]
            exits = _exits(t, first_end, width, (block + 1) * per_block * width)
            later = int(np.searchsorted(t, first_end))
            enter.append(t[:later])
            leaves.append(exits)
            if later < len(t):
                rest = t[later:]
                enter.append(rest[:1])
                leaves.append(_exits(rest, rest[0] + 1, width, 0)[:1])
            rows.append(np.full(later + (later < len(t)), a))
        return frame[key].iloc[np.concatenate(rows)].assign(_block=block, enter=np.concatenate(enter), leave=np.concatenate(leaves))

    doors = blocked.groupBy("_bucket", "_block").applyInPandas(leave, f"{names}, _block long, enter long, leave long")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """In order of key and block: the allowed time with which each block is entered."""
        now, allowed, block, done = None, None, None, False
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                at = tuple(getattr(row, k) for k in key)
                if at != now:
                    now, allowed, block, done = at, row.enter, None, False
                if row.block != block:
                    block, done = row.block, False
                    out.append((*at, block, allowed))
                if not done and row.enter >= allowed:
                    allowed, done = row.leave, True
            yield pd.DataFrame(out, columns=[*key, "_block", "_allowed"])

    ordered = doors.withColumnRenamed("_block", "block").repartition(*key).sortWithinPartitions(*key, "block", "enter")
    entries = ordered.mapInPandas(link, f"{names}, _block long, _allowed long")

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*key, "at"], ignore_index=True)
        every_t, allowed_at = frame["at"].to_numpy(), frame["_allowed"].to_numpy()
        every_start = np.empty(len(frame), np.int64)
        for a, b in by_key(frame):
            t, start, allowed = every_t[a:b], every_start[a:b], int(allowed_at[a])
            i = int(np.searchsorted(t, allowed))
            start[:i] = allowed - width  # the last window of an earlier block goes on
            while i < len(t):
                j = int(np.searchsorted(t, t[i] + width))
                start[i:j] = t[i]
                i = j
        return frame[[*key, "at"]].assign(start=every_start)

    return blocked.join(entries, [*key, "_block"]).groupBy("_bucket", "_block").applyInPandas(mark, f"{names}, at long, start long")


def decide(requests: DataFrame, key: list[str], member: str, time: str, request: str, width: int, per_key: int, per_member: int) -> DataFrame:
    """Each request with its window and whether it is admitted, or which quota is used up and for how long (microseconds).

    ``width`` is in seconds; requests count in the order of time and then ``request``.  Only
    admitted requests use a quota; 0 means no limit; the key's quota is asked before the
    member's.  Within a window the admitted are the first ``per_member`` of each member, and of
    these the first ``per_key``; both are found by ranks that stop at the limit, so a window of
    very many requests is not gathered.  Rows without time or key are in no window and are left out.
    """
    micros = width * 1_000_000
    stamped = requests.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).dropna(subset=[*key, "_at"])
    starts = window_starts(stamped.select(*key, F.col("_at").alias("at")).distinct(), key, micros)
    placed = stamped.join(starts.withColumnRenamed("at", "_at"), [*key, "_at"])
    own = [*key, "start"]
    turn = F.struct("_at", request)
    limit = 1 << 62
    by_member = Window.partitionBy(*own, member).orderBy("_at", request)
    first = placed.select(*own, member, "_at", request).withColumn("_rank", F.row_number().over(by_member)).filter(F.col("_rank") <= (per_member or limit))
    by_key = Window.partitionBy(*own).orderBy("_at", request)
    counted = first.withColumn("_all", F.row_number().over(by_key)).filter(F.col("_all") <= (per_key or limit))
    full = counted.filter(F.col("_all") == (per_key or limit)).select(*own, turn.alias("_full"))
    spent = first.filter(F.col("_rank") == (per_member or limit)).select(*own, member, turn.alias("_spent"))
    out = placed.join(full, own, "left").join(spent, [*own, member], "left")
    over_key = F.coalesce(turn > F.col("_full"), F.lit(False))
    over_member = F.coalesce(turn > F.col("_spent"), F.lit(False))
    reason = F.when(over_key, "key_quota").when(over_member, "member_quota")
    return out.select(*[c for c in requests.columns], F.col("start").alias("window_start"), reason.isNull().alias("admitted"), reason.alias("denied"), F.when(reason.isNotNull(), F.col("start") + micros - F.col("_at")).alias("retry_after"))


def totals(decided: DataFrame, key: list[str], member: str) -> DataFrame:
    """Admitted and denied requests per window and member."""
    return decided.groupBy(*key, "window_start", member).agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("denied"))
