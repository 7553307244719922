"""Change producers and their projection, in one go and as a stream."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import paging
from tidemark.sources import changes
from tidemark.sources.telemetry import telemetry
from tidemark.streaming import feed
from tidemark.streaming.projection import GraphStore, insert_if_absent, project_stream, purge_expired


def tables(spark, sf_dir):
    names = sorted({n for _, needs in changes.PRODUCERS.values() for n in needs})
    return dict(zip(names, telemetry(spark, sf_dir, *names), strict=True))


def test_every_producer_emits_its_shape(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = changes.all_changes(t)
    assert [f"{n} {k}" for n, k in out.dtypes][:-1] == changes.CHANGE.split(", ")
    counts = {r.producer: r["count"] for r in out.groupBy("producer").count().collect()}
    assert set(counts) == set(changes.PRODUCERS) and all(counts.values())
    assert out.filter("relation IS NOT NULL").filter(~F.col("relation").isin(*changes.RELATIONS)).isEmpty()
    ops = {r.op for r in out.select("op").distinct().collect()}
    assert ops == {"node", "edge", "node_tombstone", "edge_tombstone", "orphan_tombstone"}


def test_batches_apply_once_heal_stubs_and_roll_back(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda op, kind, node, s=None, t=None, day=0: (op, kind, node, node, s, t, "BLOCKS" if s else None, None, None, t0 + dt.timedelta(day))
    make = lambda rows: spark.createDataFrame(rows, changes.CHANGE)
    store = GraphStore(spark, f"file://{tmp_path}/g")
    first = make([row("node", "work_item", "a"), row("node", "work_item_ref", "r"), row("edge", "relationship", "e1", "a", "r")])
    assert store.apply(first, 0) and not store.apply(first, 0)
    second = make([row("node", "work_item", "b", day=1), row("edge", "relationship", "e2", "a", "b", 1), row("edge_tombstone", "relationship", "e1", "a", "r", 1), row("orphan_tombstone", "work_item_ref", "r", day=1)])
    assert store.apply(second, 1)
    names = lambda table: sorted(r.node_id for r in store.read(table).collect())
    assert names("nodes") == ["a", "b"] and names("edges") == ["e2"]
    store.rollback()
    assert names("nodes") == ["a", "r"]
    assert store.rebuild(second) == 1 and names("nodes") == ["b"]
    assert store.retire() and not store.retire() and names("nodes") == ["b"]


def test_removed_nodes_take_edges_and_late_stubs_stay(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda op, kind, node, s=None, t=None, day=0: (op, kind, node, node, s, t, "BLOCKS" if s else None, None, None, t0 + dt.timedelta(day))
    make = lambda rows: spark.createDataFrame(rows, changes.CHANGE)
    store = GraphStore(spark, f"file://{tmp_path}/g")
    names = lambda table: sorted(r.node_id for r in store.read(table).collect())
    store.apply(make([row("node", "work_item", x) for x in "abc"] + [row("edge", "relationship", "e1", "a", "b"), row("edge", "relationship", "e2", "a", "c")]), 0)
    store.apply(make([row("node_tombstone", "work_item", "b", day=1), row("node", "work_item_ref", "late", day=5), row("node", "work_item_ref", "old", day=1)]), 1)
    assert names("nodes") == ["a", "c", "late", "old"] and names("edges") == ["e2"]
    store.apply(make([row("orphan_tombstone", "work_item_ref", "late", day=2), row("orphan_tombstone", "work_item_ref", "old", day=2)]), 2)
    assert names("nodes") == ["a", "c", "late"]
    store.rollback()
    assert names("nodes") == ["a", "c", "late", "old"] and store.pointer().batch == 1
    (tmp_path / "g" / "pointers" / "_next-1").write_text("a crash left this")
    assert names("edges") == ["e2"]
    assert store.apply(make([row("orphan_tombstone", "work_item_ref", "old", day=2)]), 2) and names("nodes") == ["a", "c", "late"]


def test_a_stream_gives_what_one_batch_gives(spark, sf_dir, tmp_path):
    t = tables(spark, sf_dir)
    out = changes.hierarchy(t).unionByName(changes.repositories(t))
    out.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = GraphStore(spark, f"file://{tmp_path}/g")
    project_stream(stream, store, f"{tmp_path}/check").awaitTermination(120)
    assert store.pointer().batch == 2
    assert store.read("edges").count() == out.filter("op = 'edge'").select("node_id").distinct().count()
    assert store.read("nodes").count() == 25


def test_idempotent_insert_and_retention(spark):
    state = spark.createDataFrame([(1, "x"), (2, "y")], "id int, payload string")
    new, conflicts = insert_if_absent(state, spark.createDataFrame([(2, "y"), (1, "z"), (3, "n")], "id int, payload string"), ["id"], "payload")
    assert [r.id for r in new.collect()] == [3] and [r.id for r in conflicts.collect()] == [1]
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, e int")
    assert sorted(r.id for r in purge_expired(rows, "e", 5).collect()) == [2, 3]


T0 = dt.datetime(2024, 1, 1)


def change(op, kind, node, s=None, t=None, day=0):
    return (op, kind, node, node, s, t, "BLOCKS" if s else None, None, None, T0 + dt.timedelta(day))


def plain_graph(batches):
    """The same rules row by row: edges, then nodes, then tombstones, batch by batch."""
    nodes, edges = {}, {}
    for rows in batches:
        for op, _, node, label, s, t, *_, at in rows:
            if op == "edge":
                edges[node] = (s, t, at)
        for op, _, node, *_, at in rows:
            if op == "edge_tombstone" and node in edges and edges[node][2] <= at:
                del edges[node]
        best = {}
        for op, _, node, label, *_, at in rows:
            if op == "node" and (node not in best or (at, ) > best[node][:1]):
                best[node] = (at, label)
        nodes |= best
        for op, _, node, *_, at in rows:
            if op == "node_tombstone" and node in nodes and nodes[node][0] <= at:
                del nodes[node]
                edges = {e: x for e, x in edges.items() if node not in x[:2]}
        touched = {x for e in edges.values() for x in e[:2]}
        for op, _, node, *_, at in rows:
            if op == "orphan_tombstone" and node in nodes and node not in touched and nodes[node][0] <= at:
                del nodes[node]
    return sorted(nodes), sorted(edges)


def test_a_small_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, changes.CHANGE)
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=32)
    first = [change("node", "work_item", f"n{i}") for i in range(300)] + [change("edge", "relationship", f"e{i}", f"n{i}", f"n{(i * 7 + 1) % 300}") for i in range(300)]
    second = [change("node", "work_item", "n5", day=1), change("node_tombstone", "work_item", "n8", day=1), change("edge", "relationship", "new", "n5", "n6", 1)]
    third = [change("edge_tombstone", "relationship", "e9", "n9", "n64", 2), change("node", "work_item_ref", "stub", day=1), change("orphan_tombstone", "work_item_ref", "stub", day=2)]
    store.apply(make(first), 0)
    before = store.pointer()
    store.apply(make(second), 1)
    now = store.pointer()
    assert sum(now.nodes[b] != at for b, at in before.nodes.items()) <= 2
    changed = {b for b, at in before.edges.items() if now.edges.get(b) != at}
    bucket = lambda *ids: {str(r[0]) for r in spark.createDataFrame([(i,) for i in ids], "i string").select(store.bucket(F.col("i"))).collect()}
    ends = {x for i, s, t in ((f"e{i}", f"n{i}", f"n{(i * 7 + 1) % 300}") for i in range(300)) for x in (s, t) if "n8" in (s, t)}
    assert changed <= bucket("n5", "n6", "n8", *ends) and len(changed) < 16
    store.apply(make(third), 2)
    got = [sorted(r.node_id for r in store.read(table).collect()) for table in ("nodes", "edges")]
    assert tuple(got) == plain_graph([first, second, third])
    assert {r.node_id for r in store.around(["n5"]).collect()} == {e for e in got[1] if e in ("new", "e5") or e in {f"e{i}" for i in range(300) if (i * 7 + 1) % 300 == 5}}


def test_a_crash_at_any_write_leaves_what_was_served(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, changes.CHANGE)
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=4)
    names = lambda: [sorted(r.node_id for r in store.read(table).collect()) for table in ("nodes", "edges")]
    store.apply(make([change("node", "work_item", x) for x in "abc"] + [change("edge", "relationship", "e", "a", "b")]), 0)
    served = names()
    write, move = GraphStore._write, GraphStore._move
    for fail_at in (1, 2, 3):
        calls = []

        def failing(self, *a, _real=write, _n=fail_at, _calls=calls):
            _calls.append(1)
            if len(_calls) == _n:
                raise OSError("lost")
            return _real(self, *a)

        monkeypatch.setattr(GraphStore, "_write", failing)
        if fail_at == 3:
            monkeypatch.setattr(GraphStore, "_move", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        for act in (lambda: store.rebuild(make([change("node", "work_item", "z")])), lambda: store.apply(make([change("node_tombstone", "work_item", "a", day=1)]), 1)):
            calls.clear()
            try:
                act()
                raise AssertionError("went through")
            except OSError:
                pass
            assert names() == served
    monkeypatch.setattr(GraphStore, "_write", write)
    monkeypatch.setattr(GraphStore, "_move", move)
    assert store.rebuild(make([change("node", "work_item", "y")])) == 1 and names() == [["y"], []]
    assert store.apply(make([change("node", "work_item", "x")]), 1) and names() == [["x", "y"], []]
    store.purge()
    assert names() == [[], []] and not list((tmp_path / "g").glob("nodes/*"))


def staged_feed(spark, tmp_path, rows, version="v1", **limits):
    found = feed.candidates(spark.createDataFrame(rows, changes.CHANGE).withColumn("producer", F.concat(F.lit("t"), F.length("node_id") % 3)))
    return feed.Feed(spark, f"file://{tmp_path}/feed", "org", "src", version, feed.Limits(**limits)), found


ROWS = [change("node", "work_item", f"n{i:03d}", day=i // 40) for i in range(120)] + [change("edge", "relationship", f"e{i}", f"n{i:03d}", f"n{(i + 1) % 120:03d}", i // 40) for i in range(0, 120, 2)]


def test_pages_joined_are_the_table_even_with_a_thousand_equal_keys(spark, tmp_path):
    rows = ROWS + [change("edge", "relationship", f"same{i}", "n050", f"x{i}", 1) for i in range(1000)]
    f, found = staged_feed(spark, tmp_path, rows, page_rows=7, snapshot_rows=10)
    assert f.stage(found) == "pages"
    plan = f.plan().orderBy("tick").collect()
    assert len(plan) == -(-120 // 7) and [p.cursor for p in plan[1:]] == [p.next_cursor for p in plan[:-1]]
    pages = [f.page(p.first_page, p.last_page).collect() for p in plan]
    assert sorted(r.node_id for page in pages for r in page) == sorted(r[2] for r in rows)
    keys = [sorted({(r.observed_at, r.sort_key) for r in page}) for page in pages]
    assert [k for page in keys for k in page] == sorted({k for page in keys for k in page})


def test_merged_pages_lose_nothing_between_cursors(spark):
    rows = [(T0, "k1")] * 5 + [(T0, "k2")] + [(T0 + dt.timedelta(1), "k1")] * 3 + [(T0 + dt.timedelta(1), "k3")]
    table = {"t": spark.createDataFrame(rows, "at timestamp_ntz, key string"), "u": spark.createDataFrame(rows[:2], "at timestamp_ntz, key string")}
    cursor, seen = None, []
    while True:
        page = paging.merged_page(table, "at", "key", 1, cursor).collect()
        if not page:
            break
        seen += page
        last = max((r["at"], r["key"]) for r in page)
        cursor = (F.lit(last[0]).cast("timestamp_ntz"), F.lit(last[1]))
    assert len(seen) == len(rows) + 2 and len({(r["at"], r["key"]) for r in seen}) == 4


def test_paged_projection_equals_one_batch_and_a_restart_repeats_nothing(spark, tmp_path):
    f, found = staged_feed(spark, tmp_path, ROWS, page_rows=50, snapshot_rows=10)
    f.stage(found)
    paged, whole = GraphStore(spark, f"file://{tmp_path}/paged", 4), GraphStore(spark, f"file://{tmp_path}/whole", 4)
    whole.apply(found, 0)
    first = f.tick(paged)
    # a crash between the store and the checkpoint: the page is offered again and skipped
    f._save(feed.Checkpoint("src", "v1"))
    number = paged.pointer().number
    again = feed.Feed(spark, f.root, "org", "src", "v1", f.limits)
    assert again.tick(paged) == first and paged.pointer().number == number
    while again.tick(paged):
        pass
    assert again.checkpoint().page == 2 and again.tick(paged) is None
    for table in ("nodes", "edges"):
        assert sorted(map(str, paged.read(table).collect())) == sorted(map(str, whole.read(table).collect()))
    # what comes later is staged behind the cursor only
    more = found.unionByName(feed.candidates(spark.createDataFrame([change("node", "work_item", "later", day=9)], changes.CHANGE).withColumn("producer", F.lit("t0"))))
    again.stage(more)
    assert again.tick(paged).page == 3 and again.tick(paged) is None and paged.read("nodes").count() == 121


def test_small_sources_come_as_one_snapshot(spark, tmp_path):
    f, found = staged_feed(spark, tmp_path, ROWS, page_rows=7)
    assert f.stage(found.limit(40)) == "snapshot" and f.plan().count() == 1
    over = feed.modes(found, feed.Limits(snapshot_rows=500, nodes=119)).select("mode").distinct().collect()
    assert [r.mode for r in over] == ["pages"]


def test_empty_pages_move_the_cursor_without_a_batch(spark, tmp_path):
    rows = [change("progress", "work_item", f"p{i:03d}") for i in range(130)] + [change("node", "work_item", "z", day=1)]
    f, found = staged_feed(spark, tmp_path, rows, page_rows=2, skips=50, snapshot_rows=1)
    f.stage(found)
    plan = f.plan().orderBy("tick").collect()
    # 65 empty pages: 51 are consumed without a batch, 14 and the page of z make the next tick
    assert [(p.first_page, p.last_page, p.batch_id is None) for p in plan] == [(0, 50, True), (51, 65, False)]
    store = GraphStore(spark, f"file://{tmp_path}/g", 4)
    assert f.tick(store).watermark == "" and store.pointer().number == -1
    point = f.tick(store)
    assert point.page == 65 and point.watermark.startswith("graph:") and [r.node_id for r in store.read("nodes").collect()] == ["z"]


def test_another_version_is_refused_until_a_rebuild(spark, tmp_path):
    f, found = staged_feed(spark, tmp_path, ROWS[:30], page_rows=10, snapshot_rows=1)
    store = GraphStore(spark, f"file://{tmp_path}/g", 4)
    f.stage(found)
    f.tick(store)
    newer = feed.Feed(spark, f.root, "org", "src", "v2", f.limits)
    with pytest.raises(feed.VersionChanged):
        newer.tick(store)
    with pytest.raises(feed.VersionChanged):
        newer.stage(found)
    newer.reset()
    store.rebuild(found)
    assert newer.stage(found) == "pages" and newer.checkpoint().version == "v2"


def test_a_stream_of_pages_gives_the_same_graph(spark, tmp_path):
    f, found = staged_feed(spark, tmp_path, ROWS, page_rows=50, snapshot_rows=10)
    f.stage(found)
    spark.dataSource.register(feed.PageSource)
    store = GraphStore(spark, f"file://{tmp_path}/g", 4)
    read = lambda: spark.readStream.format("feed_pages").option("path", f"{f.staged()}/pages").load()
    for most in (1, 2):  # stopped in the middle and started again from the checkpoint
        query = project_stream(read(), store, f"{tmp_path}/check", available_now=False)
        deadline = time.time() + 120
        while store.pointer().batch < most and time.time() < deadline:
            time.sleep(0.5)
        query.stop()
    assert store.pointer().batch == 2 and store.read("nodes").count() == 120 and store.read("edges").count() == 60
