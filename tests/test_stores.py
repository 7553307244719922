"""Readers and keyed stores on small cases."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import stores
from tidemark.sources import readers

T0 = dt.datetime(2024, 1, 1)


def test_code_index_payloads(spark):
    df = spark.createDataFrame([(1, json.dumps({"symbol": "f", "callers": [{"name": "g", "kind": "function", "filePath": "a.py", "startLine": 3}]})), (2, "not json"), (3, None)], "id int, payload string")
    rows = readers.code_index(df, "callers").collect()
    assert [(r.id, r["item"]["name"], r["item"]["startLine"]) for r in rows] == [(1, "g", 3)]
    df = spark.createDataFrame([(1, json.dumps([{"node": {"id": "n", "name": "f", "startLine": 1}}]))], "id int, payload string")
    assert readers.code_index(df, "query").collect()[0].name == "f"


def test_changed_files(spark):
    status = " M src/a.py\x00R  new.py\x00old.py\x00?? b c.txt\x00 M src/a.py\x00"
    assert spark.createDataFrame([(status,)], "s string").select(readers.changed_files(F.col("s"))).collect()[0][0] == ["src/a.py", "new.py", "b c.txt"]


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("[]")
    files = [{"path": "sub/a.json", "sha256": hashlib.sha256(b"{}").hexdigest()}, {"path": "b.json", "sha256": "0" * 64}, {"path": "c.json", "sha256": "0" * 64}]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": files}))
    rows = readers.verify_manifest(spark, f"file://{tmp_path}", "manifest.json").collect()
    assert {r.path: r.intact for r in rows} == {"sub/a.json": True, "b.json": False, "c.json": False}


def test_reuse_needs_key_age_epoch_and_watermark(spark):
    results = spark.createDataFrame([("r1", "q", 1, "w", T0), ("r2", "q", 1, "w", T0 + dt.timedelta(hours=1)), ("r3", "q", 2, "w", T0), ("r4", "q", 1, "v", T0), ("r5", "old", 1, "w", T0 - dt.timedelta(days=9))], "result_id string, question string, epoch int, watermark string, created_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "q", 1, "w"), (2, "q", 3, "w"), (3, "old", 1, "w")], "request_id int, question string, epoch int, watermark string")
    got = stores.reusable(results, ["question"], asked, T0 + dt.timedelta(hours=2), dt.timedelta(days=1)).collect()
    assert [(r.request_id, r.result_id) for r in got] == [(1, "r2")]


def test_claims_priors_and_epochs(spark):
    claims = spark.createDataFrame([("k", 2, "b"), ("k", 1, "c"), ("k", 1, "a"), ("t", 1, "x")], "k string, at int, result string")
    taken = spark.createDataFrame([("t",)], "k string")
    assert [(r.k, r.result) for r in stores.first_claims(claims, ["k"], "at", "result", taken).collect()] == [("k", "a")]
    versions = spark.createDataFrame([("k", 1, "old")], "k string, version int, payload string")
    pointers = spark.createDataFrame([("k", 1)], "k string, version int")
    versions, pointers = stores.publish_prior(versions, pointers, ["k"], spark.createDataFrame([("k", "new"), ("j", "first")], "k string, payload string"))
    none = spark.createDataFrame([], "k string, version int")
    assert sorted(r.payload for r in stores.served_priors(versions, pointers, ["k"], none).collect()) == ["first", "new"]
    assert sorted(r.payload for r in stores.served_priors(versions, pointers, ["k"], spark.createDataFrame([("k", 2)], "k string, version int")).collect()) == ["first"]
    epochs = stores.bump_epoch(spark.createDataFrame([("a", 4), ("b", 1)], "org_id string, epoch int"), spark.createDataFrame([("a",), ("c",), ("a",)], "org_id string"))
    assert {r.org_id: r.epoch for r in epochs.collect()} == {"a": 5, "b": 1, "c": 1}


def test_guarded_json_and_scopes(spark):
    rows = ['{"ids": ["a", "b"], "bits": [true, false]}', '{"ids": ["a", "a"], "bits": [true, false]}', '{"ids": ["a"], "bits": [true]}', '{"ids": ["a", 1], "bits": [true, false]}', '{"ids": 3}', None]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [r[0] for r in df.select(stores.panel_evidence_valid(F.col("p"))).collect()] == [True, False, False, False, False, True]
    assert [len(r[0]) for r in df.select(stores.guarded_array(F.col("p"), "ids", "string")).collect()] == [2, 2, 1, 2, 0, 0]
    assert [r[0] is None for r in df.select(stores.cleared(F.col("p"), "ids")).collect()] == [True, True, True, True, False, True]
    scopes = spark.createDataFrame([(["*"], "o/r"), (["o/*"], "o/r"), (["o/*"], "oo/r"), (["o/r"], "o/r"), ([], "o/r")], "s array<string>, slug string")
    assert [r[0] for r in scopes.select(stores.in_scope(F.col("s"), F.col("slug"))).collect()] == [True, True, False, True, False]


def test_change_times_grow_and_lists_are_capped(spark):
    df = spark.createDataFrame([(T0, T0), (T0 + dt.timedelta(1), T0)], "now timestamp_ntz, before timestamp_ntz")
    assert [r[0] for r in df.select(stores.strictly_later(F.col("now"), F.col("before"))).collect()] == [T0 + dt.timedelta(microseconds=1), T0 + dt.timedelta(1)]
    rows = spark.createDataFrame([("p", "driver", i) for i in range(5)] + [("p", "fact", 1)], "g string, kind string, i int")
    got = stores.cap_lists(rows, ["g"], "kind", [F.col("i")], {"driver": 2, "fact": 3}).collect()
    assert sorted((r.kind, r.i, r.omitted) for r in got) == [("driver", 0, 3), ("driver", 1, 3), ("fact", 1, 0)]
