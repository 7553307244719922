"""Census rounds, context paths, fact plans, retrieval, ranks and packets on small cases against plain recounts."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import census, fact_plan, locators, packets, paths, ranks, retrieval, search
from tidemark.plans import packet
from tidemark.plans.queries import NOW, queries
from tidemark.sources.evidence import CATALOG, Request
from tidemark.sources.telemetry import telemetry
from tidemark.streaming.files import scratch

ASK = "question long, org_id string, handles array<struct<kind:string,value:string>>, anchor_kind string, anchor string, pooled array<string>, current boolean, unscoped boolean"
ROW = "kind string, org_id string, identity string, handle string, anchor_kind string, anchor string, at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def census_case(spark, rows, again, asks):
    a, r, b = spark.createDataFrame(asks, ASK), spark.createDataFrame(rows, ROW), spark.createDataFrame(again, ROW)
    kinds = census.attested(a, r, b)
    return {(x.question, x.kind): x for x in kinds.collect()}, {x.question: x for x in census.decided(a, kinds).collect()}


def test_a_census_decides_only_where_both_readings_agree(spark):
    pr = lambda n, repo="r1": ("pull_request", "o", f"o:{repo}:{n}", str(n), "repository", repo, T0)
    item = lambda n, project: ("work_item", "o", f"o:z:{n}", n, "project", project, T0)
    rows = [pr(1), pr(2), pr(3), pr(3, "r2"), *(item(f"W{i}", "big") for i in range(1001)), *(item(f"V{i}", "few") for i in range(3))]
    again = [pr(1), pr(9), ("pull_request", "o", "o:r1:222", "2", "repository", "r1", T0), pr(3), pr(3, "r2"), *(item(f"V{i}", "few") for i in range(2))]
    handle = lambda n: [("pull_request", str(n))]
    ask = lambda q, handles=(), kind=None, anchor=None, pooled=("pull_request",), current=True, unscoped=True, org="o": (q, org, list(handles), kind, anchor, list(pooled), current, unscoped)
    asks = [
        ask(1, handle(1)), ask(2, handle(2)), ask(3, handle(3)), ask(4, handle(3), "repository", "r2"), ask(5, handle(7)), ask(6, handle(1), current=False), ask(7, handle(1), unscoped=False),
        ask(8, handle(1) * 2), ask(9), ask(10, [("release", "1")]), ask(11, handle(1), pooled=("pull_request", "incident")), ask(12, handle(1), pooled=("work_item",)),
        ask(13, (), "project", "big", ("work_item",)), ask(14, (), "project", "few", ("work_item",)), ask(15, handle(1), org="other"), ask(16, handle(1), "project", "none", ("work_item",)),
    ]
    kinds, got = census_case(spark, rows, again, asks)
    outcomes = {q: (r.outcome, r.reason) for q, r in got.items()}
    assert outcomes[1] == ("commit", None) and got[1].only == "o:r1:1"
    assert outcomes[2] == ("clarify", "census_closure_mismatch")  # the count agrees, the row is another
    assert outcomes[3] == ("clarify", None) and kinds[3, "pull_request"].satisfier_set == ["o:r1:3", "o:r2:3"]
    assert outcomes[4] == ("commit", None) and got[4].only == "o:r2:3"
    assert outcomes[5] == ("no_match", None) and outcomes[15] == ("no_match", None)
    assert [outcomes[q][1] for q in (6, 7, 8, 9, 10)] == ["historical_axis_skip", "scoped_visibility", "multi_handle", "no_discriminators", "census_kind_unregistered"]
    assert outcomes[11] == ("clarify", None) and got[11].survivor  # incidents are not in the census
    assert outcomes[12] == ("clarify", None) and got[12].survivor and got[12].censused == 1  # no key reaches items
    assert kinds[13, "work_item"].satisfiers == 1001 and kinds[13, "work_item"].satisfier_set is None and not kinds[13, "work_item"].open_set
    assert kinds[14, "work_item"].open_set and kinds[14, "work_item"].satisfier_set is None
    assert outcomes[16] == ("commit", None) and got[16].only == "o:r1:1"  # of items there are none


def test_windowed_counts_take_both_ends_and_rows_without_time(spark):
    day = lambda n: T0 + dt.timedelta(n)
    rows = spark.createDataFrame([("ci_run", "o", str(i), str(i), "repository", "r", day(i) if i < 9 else None) for i in range(10)], ROW)
    asks = [(1, None, None, None), (2, day(2), day(4), None), (3, day(2), None, day(3)), (4, None, day(2), None), (5, None, None, day(3)), (6, day(50), day(60), None)]
    df = spark.createDataFrame([(q, "ci_run", "o", s, e, a) for q, s, e, a in asks], "question long, kind string, org_id string, start timestamp_ntz, end timestamp_ntz, as_of timestamp_ntz")
    assert {r.question: r.rows for r in census.cardinality(df, rows).collect()} == {1: 10, 2: 3, 3: 7, 4: 3, 5: 4, 6: 0}


def plain_walk(edges, seeds, hops):
    out = {}
    for request, seed in seeds:
        near, seen = {seed}, {seed}
        for hop in range(1, hops + 1):
            met = [(e, {s, t} - {n} or {n}) for e, s, t in edges for n in near if n in (s, t)]
            for e, _ in met:
                out.setdefault((request, e), hop)
            near = {x for _, ends in met for x in ends} - seen
            seen |= near
    return out


def test_hop_edges_and_budgets_are_those_of_a_plain_walk(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(25)]
    made = [(f"e{i:02d}", rng.choice(nodes), rng.choice(nodes), rng.choice(["BLOCKS", "DEPENDS_ON", "ODD"]), [f"r{rng.randrange(12)}" for _ in range(rng.randrange(4))], rng.randrange(100) / 100) for i in range(60)]
    edges = spark.createDataFrame([(*e, None) for e in made], "edge_id string, source_id string, target_id string, relation string, evidence array<string>, confidence double, valid_to timestamp_ntz")
    seeds = [("q1", "n0"), ("q2", "n1"), ("q2", "n2"), ("q3", "nowhere")]
    near = paths.hop_edges(edges, spark.createDataFrame(seeds, "request string, node string"), 2, scratch(spark, "t"))
    plain = defaultdict(dict)
    for (request, e), hop in (x for s in seeds for x in plain_walk([m[:3] for m in made], [s], 2).items()):
        plain[request, e] = min(hop, plain.get((request, e)) or 9)
    assert {(r.request, r.edge_id): r.hop for r in near.collect()} == plain
    budget = paths.Budget(evidence=5, paths=4, drivers=2, collected=20)
    got = {r.request: r for r in paths.admitted(paths.competing(edges, near, F.col("target_id") == "n3", budget.collected), ("BLOCKS", "DEPENDS_ON"), budget).collect()}
    by_id = {e[0]: e for e in made}
    for request in ("q1", "q2"):
        mine = sorted((by_id[e] for q, e in plain if q == request), key=lambda e: (-e[5], e[0]))[:20]
        ev, kept, unknown, over, loops = set(), [], [], 0, 0
        for e, s, t, relation, refs, _ in mine:
            if s == t or t == "n3" or not refs:
                loops += s == t
                continue
            if len(ev | set(refs)) > 5:
                over += 1
            elif relation == "ODD":
                unknown.append(relation)
            else:
                ev |= set(refs)
                kept.append(e)
        r = got[request]
        assert (r.accepted, r.kept, set(r.evidence), r.n_unknown, r.over_budget, r.self_loops, r.partial) == (kept, kept[:4], ev, len(unknown), over, loops, bool(unknown))
        drivers = sorted((x for x in paths.drivers(spark.createDataFrame([r]), edges, "o", 2).collect()), key=lambda x: x.place)
        assert [d.edge_id for d in drivers] == [e for e in kept if by_id[e][3] == "BLOCKS"][:2]
        assert all(d.title == f"Blocks: {by_id[d.edge_id][2]}" and d.confidence == (by_id[d.edge_id][5] or 0.55) for d in drivers)


def test_plans_tell_pruned_narrowed_and_incomplete_apart(spark):
    req = [(1, "workload", "current", 0), (1, "identity", "current", 1), (1, "health", "past", 2), (1, "identity", "current", 3), (2, "evidence", "current", 0), (2, "status", "observed", 1), (2, "metrics", "current", 2), (3, "work", "current", 0)]
    first, second = (spark.createDataFrame(r, "investigation long, fact_kind string, axis string, nth int") for r in (req[:3] + req[4:], req[3:4]))
    merged = fact_plan.merged_requirements(first, second)
    assert merged.count() == 7
    empty = "investigation long, fact_kind string, subject_kind string, subject_id string, place int"
    scope = spark.createDataFrame([(1, "work_item", "w", 0), (1, "team", "t", 1), (2, "work_item", "w", 0)], "investigation long, subject_kind string, subject_id string, place int")
    derived = spark.createDataFrame([(1, "identity", "repository", "r", 5), (1, "identity", "work_item", "w", 6)], empty)
    subjects = fact_plan.read_subjects(merged, spark.createDataFrame([], empty), scope, derived)
    gaps = spark.createDataFrame([(2, "metrics", "target_kind_mismatch", "project", "p", "b", True), (1, "identity", "target_kind_mismatch", "project", "p", "b", True)], "investigation long, fact_kind string, outcome string, origin_kind string, policy string, basis string, degrades boolean")
    got = {(r.investigation, r.fact_kind): r for r in fact_plan.plan(merged, subjects, fact_plan.capabilities(spark), gaps).collect()}
    assert {k: r.decision for k, r in got.items()} == {(1, "workload"): "narrowed", (1, "identity"): "narrowed", (1, "health"): "narrowed", (2, "evidence"): "unconfigured", (2, "status"): "refused", (2, "metrics"): "gap", (3, "work"): "no_subjects"}
    assert got[1, "identity"].asked == 3 and got[1, "identity"].readable == 2 and got[1, "identity"].incomplete
    assert got[1, "workload"].note.startswith("narrowed:subject_kind_unsupported: 1 subject(s)") and "unexpanded:" in got[1, "identity"].note


def test_facts_beyond_the_bound_are_cut_in_plan_order(spark):
    planned = spark.createDataFrame([(1, "a", i, "read") for i in [1]] + [(1, "b", 0, "read"), (1, "c", 2, "narrowed")], "investigation long, fact_kind string, nth int, decision string")
    facts = spark.createDataFrame([(1, k, i) for k, n in (("a", 4), ("b", 3), ("c", 5)) for i in range(n)], "investigation long, fact_kind string, place int")
    kept = fact_plan.kept_facts(planned, facts, 5).collect()
    assert sorted((r.fact_kind, r.place) for r in kept) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]


def hashed(text, size):
    import hashlib
    import re

    out, words = [0.0] * size, []
    for w in re.split(r"[\s|&()\[\]{}~^*:\"'@%<>=!,;]+", text.lower()):
        w = re.sub(r"^[\W]+", "", w)
        if w and w not in words:
            words.append(w)
    for w in words:
        code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        out[code % size] += 1.0 if code // size % 2 == 0 else -1.0
    return out if words else None


def test_vectors_are_made_once_per_text_and_identity(spark, tmp_path):
    made = []
    table = retrieval.VectorTable(spark, f"file://{tmp_path}", "one")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    embed = lambda c: made.append(1) or retrieval.hashed_vector(c, 8)
    got = table.add(texts("red bolt", "red bolt", "blue", None, "!!"), embed)
    want = {x: hashed(x, 8) for x in ("red bolt", "blue")}
    by_hash = {r.text_hash: r.vector for r in got.join(texts("red bolt", "blue").select(F.sha2("text", 256).alias("text_hash")), "text_hash").collect()}
    assert sorted(by_hash.values()) == sorted(want.values()) and got.count() == 2
    assert sorted(r.text for r in table.missing(texts("blue", "new", "!!")).collect()) == ["!!", "new"]
    table.add(texts("blue", "new"), embed)
    assert spark.read.parquet(table.path).count() == 3
    other = retrieval.VectorTable(spark, f"file://{tmp_path}", "two")
    assert other.missing(texts("blue")).count() == 1 and other.read().count() == 0


def test_the_vector_arm_is_suppressed_for_the_past_and_degrades(spark):
    subjects = spark.createDataFrame([(i, t) for i, t in enumerate(["red bolt", "red nut", "blue bolt", "green gear"])], "node_id long, text string")
    asks = spark.createDataFrame([(10, "red bolt", False, True), (11, "red bolt", True, True), (12, "bolt", False, False), (13, "?!", False, True), (14, "unheard of", False, True)], "query_id long, query string, historical boolean, configured boolean")
    vec = lambda df, key, text: df.select(key, retrieval.hashed_vector(F.col(text), 16).alias("vector")).filter("vector IS NOT NULL")
    found, flags = retrieval.hybrid_search(subjects, asks, vec(subjects, "node_id", "text"), vec(asks.filter("query_id <> 14"), "query_id", "query"), 2, 0.3)
    arms = defaultdict(set)
    for r in found.collect():
        arms[r.query_id].add(r.mechanism)
    assert arms == {10: {"lexical", "vector"}, 11: {"lexical"}, 12: {"lexical"}}
    got = {r.query_id: (r.truncated, r.degraded) for r in flags.collect()}
    assert got == {10: (True, False), 11: (True, True), 12: (False, False), 13: (False, False), 14: (False, True)}


def test_sure_matches_go_first_and_add_no_confidence_of_their_own(spark):
    found = spark.createDataFrame([(1, 1, "lexical", 0.6), (1, 2, "vector", 0.7), (1, 3, "lexical", None), (1, 4, "alias", 0.6)], "query_id long, node_id long, mechanism string, relevance double")
    asks = spark.createDataFrame([(1, "  Alpha ")], "query_id long, query string")
    names = spark.createDataFrame([(1, "ALPHA", "label"), (1, "alpha", "alias"), (2, "alpha", "alias"), (3, "alpha", "provider_key"), (4, "beta", "label")], "node_id long, name string, class string")
    got = {r.node_id: (r.base, r.reason, r.mechanisms) for r in retrieval.mechanisms_of(retrieval.promoted(found, asks, names)).collect()}
    assert got == {
        1: (1.0, retrieval.EXACT_REASON, ["exact", "lexical"]), 2: (0.7, retrieval.ALIAS_REASON, ["alias", "vector"]),
        3: (0.5, retrieval.KEY_REASON, ["provider_key", "lexical"]), 4: (0.6, retrieval.ALIAS_REASON, ["alias"]),
    }
    plain = retrieval.mechanisms_of(retrieval.promoted(found, asks, names, allow_exact=False)).filter("base = 1").count()
    assert plain == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_values_at_ranks_are_those_of_sorted_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(7), rng.random() * 100])) for _ in range(900)] + [("one", 5.0)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(6)
    got = {r.g: (r.low, r.mid, r.top) for r in ranks.values_at_ranks(df, ["g"], "v", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).collect()}
    for g in {g for g, _ in rows}:
        mine = sorted((float(v) if v is not None else -math.inf for h, v in rows if h == g))
        want = [mine[0], mine[len(mine) // 2], mine[-1]]
        assert got[g] == tuple(None if x == -math.inf else x for x in want)


def test_no_plan_orders_a_whole_group_or_table(spark, sf_dir):
    for name in ("timing_by_type", "percentile_floor_index", "percentile_nearest_rank", "floor_calibration"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("sum(_n" in w or "sum(_size" in w for w in windows), plan
        assert "percentile" not in plan


def test_a_packet_is_read_once_and_counts_what_breaks_a_rule(spark, sf_dir):
    names = sorted({n for _, needs, _ in CATALOG.values() for n in needs})
    tables = dict(zip(names, telemetry(spark, sf_dir, *names), strict=True))
    del tables["file_hotspot_daily"]
    got = packet.assemble(tables, Request("org-3", "repo-8", now=NOW), "fix", packet.Limits(items=12, bytes=3000))
    items = got.items.collect()
    assert [r["rank"] for r in items] == sorted(r["rank"] for r in items) and len(items) <= 12
    (totals,), (state,) = got.totals.collect(), got.state.collect()
    assert totals.items_used == len(items) and totals.serialized_bytes <= 3000 and totals.estimated_tokens == sum(r.tokens for r in items)
    assert any(w.startswith("source_unavailable:file_hotspots") for w in state.warnings) and state.status == "partial"
    assert set(state.checks) == {f"check.{r.rule_id}" for r in items}
    plan = got.items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 20


def test_quarantined_rows_do_not_make_a_source_fresh(spark):
    kind = "source string, observed_at timestamp_ntz"
    valid = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(30))], kind)
    bad = spark.createDataFrame([("b", T0, "uri"), ("b", T0, "id"), ("c", T0, "id")], f"{kind}, broken string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    got = {r.source: (r.freshness, r.quarantined, r.rules) for r in packets.quarantined_watermarks(names, valid, bad, T0).collect()}
    assert got == {"a": ("fresh", 0, []), "b": ("stale", 2, ["id", "uri"]), "c": ("missing", 1, ["id"]), "d": ("missing", 0, [])}


def test_hybrid_candidates_are_those_of_plain_scoring(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    got = defaultdict(dict)
    for r in queries()["hybrid_candidates"](spark, sf_dir).collect():
        got[r.query_id][r.node_id] = r
    subjects = {p.p_partkey: f"{p.p_name} {p.p_brand}" for p in parts}
    unit = lambda v: math.sqrt(sum(x * x for x in v))
    vectors = {k: v for k, t in subjects.items() if (v := hashed(t, 32)) and unit(v)}
    checked = 0
    for p in parts:
        k = p.p_partkey
        if k % 50 or k % 350 == 0 or k % 200 == 50 or k % 250 == 100:
            continue
        text = f"{p.p_name} {p.p_brand}" if k % 150 == 0 else p.p_name
        q = hashed(text, 32)
        sims = {n: sum(a * b for a, b in zip(q, v)) / unit(q) / unit(v) for n, v in vectors.items() if n != k}
        best = sorted((round(s, 9) for s in sims.values() if s > 0.4), reverse=True)[:10]
        mine = {n: r for n, r in got[k].items() if "vector" in r.mechanisms}
        assert sorted((round(sims[n], 9) for n in mine), reverse=True) == best
        checked += 1
    assert checked
    assert search.VECTOR_BASE == 0.5


def test_handles_are_looked_up_at_once_and_saturation_is_told(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    evidence = spark.createDataFrame([("s", "r", f"id{i}") for i in range(4)] + [("s", "r", "twice")] * 2 + [("t", "r", "one")], "source string, repo_id string, evidence_ref_id string")
    asked = [(1, "s", "r", sha("id1")), (2, "s", "r", sha("twice")), (3, "s", "r", sha("none")), (4, "s", "r", None), (5, "t", "r", None), (6, "s", "r", "short"), (7, "s", "other", sha("id1")), (8, "u", "r", None), (9, "s", "r", sha("id1"))]
    handles = spark.createDataFrame(asked, "handle long, source string, repo_id string, locator string")
    states, found = locators.resolve_handles(evidence, handles, listed=5)
    assert {r.handle: (r.state, r.matches) for r in states.collect()} == {
        1: ("found", 1), 2: ("saturated", 2), 3: ("not_found", 0), 4: ("saturated", 6), 5: ("found", 1), 6: ("invalid", 0), 7: ("not_found", 0), 8: ("not_found", 0), 9: ("found", 1),
    }
    assert sorted((r.handle, r.evidence_ref_id) for r in found.collect()) == [(1, "id1"), (5, "one"), (9, "id1")]
