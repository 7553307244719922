"""Quota windows in batch and as a stream, against a plain recount."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import quota
from tidemark.streaming.quota import quota_stream

T0 = dt.datetime(2024, 1, 1)


def plain(rows, width, per_key, per_member):
    """rows: (key, member, request, microseconds)."""
    out, state = {}, {}
    for key, member, request, at in sorted(rows, key=lambda r: (r[3], r[2])):
        if key not in state or at >= state[key][0] + width * 10**6:
            state[key] = (at, [0], {})
        start, used, members = state[key]
        denied = "key_quota" if per_key and used[0] >= per_key else "member_quota" if per_member and members.get(member, 0) >= per_member else None
        if not denied:
            used[0] += 1
            members[member] = members.get(member, 0) + 1
        out[request] = (key, start, denied is None, denied, start + width * 10**6 - at if denied else None)
    return out


def requests_of(seed, n=600, keys=3, span=5000):
    rng = random.Random(seed)
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 10**6)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(keys)}"
        at = base + rng.choice([rng.randrange(span) * 10**6, rng.randrange(20) * 60 * 10**6, rng.randrange(span * 10**6)])
        rows.append((key, f"m{rng.randrange(4)}", i, at))
    return rows


def frame(spark, rows):
    made = [(k, m, r, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at)) for k, m, r, at in rows]
    return spark.createDataFrame(made, "key string, member string, request long, time timestamp_ntz")


def got_of(rows):
    return {r.request: (r.key, r.window_start, r.admitted, r.denied, r.retry_after) for r in rows}


def test_batch_decisions_are_those_of_a_plain_recount(spark, monkeypatch):
    for seed, width, per_key, per_member, bound in ((1, 60, 5, 2, 10**6), (2, 60, 0, 1, 7), (3, 7, 3, 0, 1), (4, 900, 40, 9, 50)):
        monkeypatch.setattr(quota, "TIMES_PER_BLOCK", bound)  # so that chains cross blocks
        rows = requests_of(seed)
        out = quota.decide(frame(spark, rows), ["key"], "member", "time", "request", width, per_key, per_member)
        assert got_of(out.collect()) == plain(rows, width, per_key, per_member)


def test_no_window_gathers_all_requests_of_one(spark):
    out = quota.decide(frame(spark, requests_of(1, 20)), ["key"], "member", "time", "request", 60, 5, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_rows_without_time_or_key_are_left_out(spark):
    df = spark.createDataFrame([(None, "m", 1, T0), ("k", "m", 2, None), ("k", None, 3, T0)], "key string, member string, request long, time timestamp_ntz")
    assert [r.request for r in quota.decide(df, ["key"], "member", "time", "request", 60, 5, 2).collect()] == [3]
    assert quota.decide(df.limit(0), ["key"], "member", "time", "request", 60, 5, 2).count() == 0


def test_a_stream_decides_as_the_batch_does(spark, tmp_path):
    rows = sorted(requests_of(5, 120), key=lambda r: (r[3], r[2]))
    for i in range(3):  # three files in the order of time
        frame(spark, rows[i * 40 : (i + 1) * 40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, member string, request long, time timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = quota_stream(stream, 60, 3, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    streamed = got_of(spark.read.parquet(f"{tmp_path}/out").collect())
    batch = quota.decide(frame(spark, rows), ["key"], "member", "time", "request", 60, 3, 2).collect()
    assert streamed == got_of(batch) == plain(rows, 60, 3, 2)


def test_keys_of_one_bucket_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(quota, "TIMES_PER_BUCKET", 90)
    monkeypatch.setattr(quota, "TIMES_PER_BLOCK", 7)
    rows = requests_of(5, n=300, keys=40, span=900)
    got = got_of(quota.decide(frame(spark, rows), ["key"], "member", "time", "request", 60, 3, 2).collect())
    assert got == plain(rows, 60, 3, 2) and len({v[0] for v in got.values()}) > 30
