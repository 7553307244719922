"""What a query sorts, joins or stores grows no faster than what it is asked for."""

import datetime as dt

from tidemark.operators import facts, graph
from tidemark.sources import changes, evidence


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_that_never_were_in_the_repository_are_not_sorted(spark, monkeypatch):
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("a", "r", "o", at[0]), ("a", "s", "o", at[1]), ("b", "s", "o", at[0]), ("b", "r", "o", at[1]), ("c", "s", "o", at[2]), ("d", "r", "p", at[0])]
    items = spark.createDataFrame(rows, "work_item_id string, repo_id string, org_id string, last_synced timestamp_ntz")
    sorted_ids = []

    def spy(df, *args):
        sorted_ids.extend(r.work_item_id for r in df.collect())
        return kept(df, *args)

    kept = evidence.latest_version
    monkeypatch.setattr(evidence, "latest_version", spy)
    got = evidence._items({"work_items": items}, evidence.Request("o", "r")).collect()
    assert [(r.work_item_id, r.repo_id) for r in got] == [("b", "r")]  # the newest version of a lies elsewhere
    assert sorted(sorted_ids) == ["a", "a", "b", "b"]


def test_a_walk_leaves_out_edges_it_does_not_touch_before_they_are_grouped(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(graph, "stored", lambda df, name: frames.append(df) or df.cache())
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a"), ("p", "q"), ("a", "b")], "s string, t string").groupBy("s", "t").count().select("s", "t")
    got = {(r.node, r.hop) for r in graph.walk(edges, spark.createDataFrame([("a",)], "seed string"), 2, "s", "t").collect()}
    assert got == {("a", 0), ("b", 1), ("x", 1), ("c", 2)}
    assert "LeftSemi" in plan_of(frames[1])


def test_dependencies_are_joined_once_for_both_relations(spark, sf_dir):
    from tidemark.sources.telemetry import telemetry

    t = dict(zip(("work_items", "work_item_dependencies"), telemetry(spark, sf_dir, "work_items", "work_item_dependencies"), strict=True))
    assert plan_of(changes.dependencies(t)).count("LeftOuter") == 1


def test_versions_of_which_only_the_key_is_told_are_not_sorted(spark):
    d = spark.createDataFrame([("a", "b", "blocks", 1), ("a", "b", "blocks", 2), ("a", "c", "other", 1), ("a", "c", "other", 3), ("z", "c", "other", 1)], "source_work_item_id string, target_work_item_id string, relationship_type string, last_synced int")
    items = spark.createDataFrame([("a",), ("b",)], "work_item_id string")
    out = {b: facts.dependency_facts({"work_item_dependencies": d, "work_items": items}, b) for b in (True, False)}
    assert {b: [(r.subject_id, r.value) for r in df.collect()] for b, df in out.items()} == {True: [("b", "a")], False: [("a", "c")]}
    assert all("Window" not in plan_of(df) for df in out.values())


def test_reads_need_no_plan_and_kinds_are_not_shuffled(spark, sf_dir):
    from tidemark.operators import fact_plan
    from tidemark.plans import fact_rounds

    got = fact_rounds._Inputs(spark, sf_dir)
    planned = fact_plan.planned_reads(got.planned, got.subjects, got.capable)
    short = fact_rounds.fact_reads(spark, sf_dir)
    assert sorted(short.collect()) == sorted(planned.collect()) and short.count() > 0
    assert plan_of(short).count("Aggregate") < plan_of(planned).count("Aggregate")
    assert plan_of(got.planned).count("strategy=broadcast") == 2


def test_edges_of_context_paths_are_derived_once(spark, sf_dir):
    from tidemark.plans.queries import queries

    assert "l_orderkey" not in plan_of(queries()["context_paths"](spark, sf_dir))


def test_inputs_of_graph_batches_are_derived_once(spark, sf_dir):
    from tidemark.plans import rounds

    assert all("l_orderkey" not in plan_of(b) and "o_orderkey" not in plan_of(b) for b in rounds._batches(spark, sf_dir))


def test_equal_texts_are_counted_before_they_are_cut_into_words(spark, monkeypatch):
    from tidemark.operators import search

    made = {}
    monkeypatch.setattr(search, "stored", lambda df, name: made.setdefault(name, df))
    docs = spark.createDataFrame([(i, ("red ring", "Ring red", None)[i % 3]) for i in range(30)], "id long, text string")
    got = search.lexical_search_blocks(docs, spark.createDataFrame([(1, "red")], "query_id long, query string"), "id", "text", 3).collect()
    assert sorted((r.id, r.truncated) for r in got) == [(0, True), (1, True), (3, True)]
    assert "split(" not in plan_of(made["classes"]) and sorted(r._n for r in made["classes"].collect()) == [10, 10]


def test_vectors_of_texts_meet_classes_of_rows(spark):
    from tidemark.operators import search

    from .test_whole_jobs import joined_rows

    texts = spark.createDataFrame([(i, f"h{i % 5}") for i in range(100)], "id long, text_hash string")
    made = spark.createDataFrame([(f"h{i}", [1.0, float(i % 3)]) for i in range(4)], "text_hash string, vector array<double>")
    each = texts.join(made, "text_hash").select("id", "vector")
    asked = each.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    plain, short = (search.nearest_blocks(v, asked, "id", "vector", "query_id", 30, 0.1, t) for v, t in ((each, None), (made, texts)))
    assert sorted(short.collect()) == sorted(plain.collect()) and short.count() == 300
    classes = search._united(search._classes(texts, "id", "text_hash", 31).join(made, "text_hash").drop("text_hash"), "vector", 31)
    assert sorted((r._n, r._ids[:2]) for r in classes.collect()) == [(20, [1, 6]), (20, [2, 7]), (40, [0, 3])]
    assert joined_rows(classes) <= 5


def test_rows_that_no_question_names_are_not_counted_by_handle(spark, monkeypatch):
    from tidemark.operators import census, locators

    met = {}
    monkeypatch.setattr(census, "stored", lambda df, name: met.setdefault(name, []).append(df) or df)
    rows = spark.createDataFrame([("ci_run", "o", f"o:r:{i}", str(i), "repository", "r", None) for i in range(50)], "kind string, org_id string, identity string, handle string, anchor_kind string, anchor string, at timestamp_ntz")
    one = [{"kind": "ci_run", "value": "7"}]
    asks = spark.createDataFrame([(1, "o", one, None, None, [], True, True), (2, "o", one, "repository", "r", [], True, True), (3, "o", [], "repository", "r", ["ci_run"], True, True)], "question long, org_id string, handles array<struct<kind:string,value:string>>, anchor_kind string, anchor string, pooled array<string>, current boolean, unscoped boolean")
    kinds = census.attested(asks, rows, rows)
    assert {r.question: (r.satisfiers, r.only, len(r.satisfier_set or [])) for r in kinds.collect()} == {1: (1, "o:r:7", 0), 2: (1, "o:r:7", 0), 3: (50, None, 50)}
    assert [df.count() for df in met["near"]] == [1, 1]
    assert all("min(" not in plan_of(df) for df in met["counts"])  # a least text is found by sorting
    placed = spark.createDataFrame([(1, "b", "ci_run", "o:r:7"), (1, "a", "ci_run", "x"), (9, "c", "ci_run", "y")], "question long, place string, kind string, node_id string")
    out = locators.survivors_first(placed.repartition("question"), kinds)
    assert sorted((r.question, r.rank, r.node_id, r.ruled_out) for r in out.collect()) == [(1, 1, "o:r:7", False), (1, 2, "x", True), (9, 1, "y", False)]
    assert "hashpartitioning(question#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", kind#" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_times_meet_the_windows_that_ask_for_them_and_rows_are_not_stored(spark, sf_dir, monkeypatch):
    from tidemark.plans import rounds

    def never(df, name):
        raise AssertionError(name)

    monkeypatch.setattr(rounds, "stored", never)
    out = rounds.census_windows(spark, sf_dir)
    (met,) = [line for line in plan_of(out).splitlines() if "Join" in line and "_low" in line]
    assert "Join Inner" in met  # a left join cannot send the few windows to the rows, of which a kind and organization then are one task's
    assert out.count() == 160


def test_a_plan_counts_without_sets_and_sorts_no_requirements(spark, sf_dir):
    from tidemark.operators import fact_plan
    from tidemark.plans import fact_rounds

    got = fact_rounds._Inputs(spark, sf_dir)
    assert all(x not in plan_of(got.planned) for x in ("collect_set", "Window", "min(l_returnflag"))
    by_set = fact_plan.plan(got.requirements, got.subjects, got.capable, got.gaps)
    key = lambda r: (r.investigation, r.fact_kind)
    assert sorted(got.planned.collect(), key=key) == sorted(by_set.collect(), key=key)
    wide = [spark.createDataFrame(rows, "investigation long, fact_kind string, nth int") for rows in ([(1, "a", 5), (1, "b", -2), (1, "b", -3)], [(1, "a", 0), (1, "c", 2**31 - 1), (2, "a", 1)])]
    merged = fact_plan.merged_requirements(*wide)
    assert "Window" not in plan_of(merged) and sorted(map(tuple, merged.collect())) == [(1, "a", 5), (1, "b", -3), (1, "c", 2**31 - 1), (2, "a", 1)]


def test_rounds_of_a_batch_are_bounded_and_give_the_same_graph(spark, tmp_path, monkeypatch):
    import random

    from tidemark.streaming.projection import GraphStore

    from .test_streaming import change, plain_graph

    made, at, write = random.Random(4), {}, GraphStore._write
    batches = []
    for day in range(4):
        rows = [change("node", made.choice(("work_item", "work_item_ref")), f"n{made.randrange(60)}", day=day + made.randrange(3)) for _ in range(30)]
        for op, most in (("edge", 60), ("edge_tombstone", 25)):
            rows += [change(op, "relationship", f"n{s}>n{t}", f"n{s}", f"n{t}", day + made.randrange(3)) for s, t in ((made.randrange(70), made.randrange(70)) for _ in range(most))]
        if day == 3:
            rows = rows[30:32] + rows[95:97]  # few buckets: most of the edges' other ends are in none of them
        rows += [change(op, "work_item", f"n{made.randrange(60)}", day=day + made.randrange(3)) for op in ("node_tombstone", "orphan_tombstone") for _ in range(2 if day == 3 else 9)]
        best = {}  # rows of one node at one time would tie
        batches.append([best.setdefault((r[0], r[2], r[-1]), r) for r in rows if (r[0], r[2], r[-1]) not in best])
    jobs = []
    monkeypatch.setattr(GraphStore, "_write", lambda self, rounds, *a: write(self, (jobs.append(df) or df for df in rounds), *a))
    for most in (10**9, 25):
        store = GraphStore(spark, f"file://{tmp_path}/g{most}", 16, most)
        for n, rows in enumerate(batches):
            store.apply(spark.createDataFrame(rows, changes.CHANGE), n)
            got = [sorted(r.node_id for r in store.read(table).collect()) for table in ("nodes", "edges")]
            assert tuple(got) == plain_graph(batches[: n + 1])
            ends = sorted((r.node_id, r.role) for r in store._read("edges", store.pointer()).collect())
            assert ends == sorted((e, role) for e in got[1] for role in ("in", "out"))
        at[most] = [sorted(map(str, store.read(table).collect())) for table in ("nodes", "edges")]
        assert len(jobs) == 8 if most > 25 else len(jobs) > 20
        jobs.clear()
    assert at[25] == at[10**9] and store._rounds(set(range(16)), 100) == [{i, i + 4, i + 8, i + 12} for i in range(4)]


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_batches_of_the_graph_leave_no_shuffle_files_and_move_lines_once(spark, sf_dir, monkeypatch):
    from tidemark.plans import rounds

    plans = {}
    kept = rounds.stored
    monkeypatch.setattr(rounds, "stored", lambda df, name, **options: plans.update({name: plan_of(df)}) or kept(df, name, **options))
    before = shuffle_files(spark)
    store = rounds._graph(spark, sf_dir)
    assert not shuffle_files(spark) - before
    assert "o_orderkey" not in plans["deps"] and plans["deps"].count("Join") == 1 and "Aggregate" not in plans["deps"]
    assert not [n for n in store._folder.names() if n.startswith("work-")]  # batches that are stored are not copied


def test_dependencies_move_once_to_each_end(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    items = [("a", at[0], None, None), ("a", at[1], at[5], at[2]), ("b", at[2], at[6], at[0]), ("b", at[1], None, at[3]), ("c", at[0], at[1], at[1])]
    deps = [("a", "b", "blocks", at[0]), ("a", "b", "blocks", at[4]), ("a", "b", "Blocks", at[1]), ("a", "b", "other", at[2]), ("c", "b", "other", at[6]), ("b", "x", "other", None), ("b", "x", "other", at[3]), ("z", "a", "other", at[7]), ("c", "a", None, at[7]), ("c", None, "other", at[5])]
    t = {
        "work_items": spark.createDataFrame(items, "work_item_id string, created_at timestamp_ntz, completed_at timestamp_ntz, last_synced timestamp_ntz"),
        "work_item_dependencies": spark.createDataFrame(deps, "source_work_item_id string, target_work_item_id string, relationship_type string, last_synced timestamp_ntz"),
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = changes.dependencies(t)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.op, r.relation or "", r.source_id or r.node_id or "", r.target_id or "", *((x.day if x else 0) for x in (r.valid_from, r.valid_to, r.observed_at))) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [plan.count(f"Exchange hashpartitioning({side}_work_item_id") for side in ("source", "target")] == [1, 1]
    a, b, c, ref = "work_item.v2:a", "work_item.v2:b", "work_item.v2:c", "work_item_ref.v2:"
    ab, cb = (2, 6), (2, 2)  # what both ends' newest times have in common
    assert got == sorted([
        ("edge", "BLOCKS", a, b, *ab, 5), ("edge", "BLOCKS", a, b, *ab, 2), ("edge", "DEPENDS_ON", a, b, *ab, 3), ("edge", "DEPENDS_ON", c, b, *cb, 7),
        *[("edge_tombstone", k, s, f"{ref}b", 0, 0, d) for k, s, d in (("BLOCKS", a, 5), ("BLOCKS", a, 2), ("DEPENDS_ON", a, 3), ("DEPENDS_ON", c, 7))],
        ("orphan_tombstone", "", f"{ref}b", "", 0, 0, 7),
        ("node", "", f"{ref}x", "", 0, 0, 4), ("edge", "DEPENDS_ON", b, f"{ref}x", 0, 0, 4), ("node", "", "", "", 0, 0, 6), ("edge", "DEPENDS_ON", c, "", 0, 0, 6),
    ])
