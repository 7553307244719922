"""Quota windows over a stream: one state per key, restarted by the first request after a window expires."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, member string, request long, at long, window_start long, admitted boolean, denied string, retry_after long"


class QuotaWindows(StatefulProcessor):
    """State: where the window began, what the key and its members have used of it."""

    def __init__(self, width: int, per_key: int, per_member: int) -> None:
        self.width, self.per_key, self.per_member = width * 1_000_000, per_key, per_member

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, used long, members string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, used, members = (self.window.get() if self.window.exists() else (None, 0, "{}"))
        members = json.loads(members)
        for frame in rows:
            out = []
            for r in frame.sort_values(["at", "request"]).itertuples(index=False):
                if start is None or r.at >= start + self.width:
                    start, used, members = int(r.at), 0, {}
                own, denied = members.get(r.member, 0), None
                if self.per_key and used >= self.per_key:
                    denied = "key_quota"
                elif self.per_member and own >= self.per_member:
                    denied = "member_quota"
                else:
                    used, members[r.member] = used + 1, own + 1
                out.append((key[0], r.member, r.request, r.at, start, denied is None, denied, start + self.width - r.at if denied else None))
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"retry_after": "Int64"})
        self.window.update((start, used, json.dumps(members)))

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, width: int, per_key: int, per_member: int) -> DataFrame:
    """Decisions on a stream of key, member, request, time, in the order in which micro-batches bring them.

    A key's requests of one micro-batch are sorted by time within each Arrow batch; the state of
    a key is one window and a count per member of it.  Needs the RocksDB state store.
    """
    rows = requests.select("key", "member", "request", F.unix_micros(F.col("time").cast("timestamp")).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(QuotaWindows(width, per_key, per_member), OUT, outputMode="Append", timeMode="None")
