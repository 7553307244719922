"""Queries over whole tables, against plain recounts."""

import datetime as dt
import hashlib
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ranking, search, stores
from tidemark.plans.queries import queries
from tidemark.sources import evidence


def table(sf_dir, name, *columns):
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns)).to_pylist()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "CHUNK_ROWS", 70)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 2)


def test_every_fiftieth_vector_is_searched_for(spark, sf_dir, small_blocks):
    rows = table(sf_dir, "embeddings", "vec_id", "embedding")
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = {}
    for q in np.flatnonzero(ids % 50 == 0):
        hits = sorted((-round(float(s), 9), int(i)) for i, s in zip(ids, x @ x[q], strict=True) if i != ids[q] and s > 0.05)[:20]
        expected |= {(int(ids[q]), p + 1): (i, -s) for p, (s, i) in enumerate(hits)}
    got = {(r.query_id, r.place): (r.hit_id, r.similarity) for r in queries()["vector_nearest_all"](spark, sf_dir).collect()}
    assert len({q for q, _ in got}) == (ids % 50 == 0).sum() > 5
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(v[1] - expected[k][1]) < 2e-9 for k, v in got.items())


def test_names_of_every_fiftieth_part_are_searched_for(spark, sf_dir, small_blocks):
    def terms(text):
        return {w for w in (re.sub(r"^\W+", "", w) for w in re.split(r"[\s|&()\[\]{}~^*:\"'@%<>=!,;]+", text.lower())) if w}

    rows = table(sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    words = {r["p_partkey"]: terms(f"{r['p_name']} {r['p_type']} {r['p_brand']}") for r in rows}
    expected = set()
    for r in rows:
        if r["p_partkey"] % 50 == 0:
            asked = terms(r["p_name"])
            hits = sorted((-len(asked & w), i) for i, w in words.items() if asked & w)
            cut = len(hits) > 50
            expected |= {(r["p_partkey"], i, -m, p + 1, cut, round(0.5 if cut else 0.5 + 0.25 * -m / len(asked), 9)) for p, (m, i) in enumerate(hits[:50])}
    got = {tuple(r) for r in queries()["lexical_matches_all"](spark, sf_dir).collect()}
    assert len({g[0] for g in got}) >= 4 and got == expected


def test_copies_tie_by_id_over_chunks(spark, small_blocks):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.nearest_blocks(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", 4).collect()
    found = {q: [r.hit_id for r in sorted(got, key=lambda r: r.place) if r.query_id == q] for q in (0, 50, 300)}
    assert found == {0: [1, 2, 3, 4], 50: [0, 1, 2, 3], 300: []}


@pytest.fixture
def compared(monkeypatch):
    """How many rows and queries meet in blocks."""
    sizes, plain = [], search._in_blocks

    def counting(rows, queries, *rest):
        sizes.append((rows.count(), queries.count()))
        return plain(rows, queries, *rest)

    monkeypatch.setattr(search, "_in_blocks", counting)
    return sizes


def test_copies_of_texts_are_compared_once(spark, compared):
    texts = ("red ring", "ring red", "blue ring", "green cup", "")
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(400)], "id long, text string")
    asks = docs.filter("id % 20 < 5").withColumnsRenamed({"id": "query_id", "text": "query"})
    got = {tuple(r) for r in search.lexical_search_blocks(docs, asks, "id", "text", 170).select("query_id", "id", "matched", "place", "truncated").collect()}
    index = search.inverted_index(docs, "id", "text")
    assert compared == [(3, 3)]
    assert got == {tuple(r) for r in search.lexical_search(index, asks, "id", 170).select("query_id", "id", "matched", "place", "truncated").collect()}
    assert len({g[0] for g in got}) == 80 and {g[4] for g in got} == {True, False}


def test_copies_of_vectors_are_compared_once(spark, compared):
    some = ([1.0, 2.0], [2.0, 4.0], [1.0, -0.0], [-1.0, -2.0])
    v = spark.createDataFrame([(i, some[i % 4]) for i in range(200)], "vec_id long, embedding array<double>")
    blocks = search.nearest_blocks(v, v.filter("vec_id % 10 = 0"), "vec_id", "embedding", "vec_id", 60, 0.1)
    got = {(r.query_id, r.place): r.hit_id for r in blocks.collect()}
    plain = search.nearest(v.withColumn("embedding", F.when(F.col("vec_id") % 4 == 1, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("embedding"))), v.filter("vec_id % 10 = 0"), "vec_id", "embedding", "vec_id", 60, 0.1)
    assert compared == [(4, 2)]
    assert got == {(r.query_id, r.place): r.hit_id for r in plain.collect()}


def joined_rows(df):
    """The most rows that any join of a frame's plan gives."""
    df.collect()
    seen, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            seen.append(plan.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return max(seen)


def test_an_incident_meets_one_mapping_of_its_service(spark):
    at = dt.datetime(2024, 1, 2)
    rows = [("org", f"i{n}", f"s{n % 2}", "t", "open", "low", at, at, 0) for n in range(60)]
    i = spark.createDataFrame(rows, "org_id string, id string, service_id string, title string, normalized_status string, normalized_severity string, started_at timestamp_ntz, observed_at timestamp_ntz, is_deleted int")
    maps = [("org", f"s{n % 2}", "repo", f"m{n:03d}", "native", None if n < 4 else 0.5 + (n % 20 == 0) / 10 + (n % 20 == 1) / 5, None, None, 1) for n in range(200)]
    m = spark.createDataFrame(maps, "org_id string, service_id string, repo_id string, id string, relationship_provenance string, relationship_confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, is_active int")
    out = evidence.incidents({"operational_incidents": i, "service_mappings": m}, evidence.Request("org", "repo", now=at))
    assert joined_rows(out) == 60
    assert {r.entity_id: r.confidence for r in out.collect()} == {f"i{n}": 0.7 if n % 2 else 0.6 for n in range(60)}


def plain_hash(question):
    """Blanks and ends as Spark's functions see them: ASCII."""
    once = re.sub(r"[ \t\n\x0b\f\r]+", " ", question).strip(" ").lower()
    return hashlib.sha256(re.sub(r"[.?!,;: \t\n\x0b\f\r]+$", "", once).encode()).hexdigest()


def test_hashes_are_of_whole_texts(spark, sf_dir):
    rows = table(sf_dir, "documents", "doc_id", "text")
    assert sum(len(r["text"]) > 200 for r in rows) > 100
    got = {r.doc_id: r["hash"] for r in queries()["question_hashes_all"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: plain_hash(f"  {r['text']} ?? ") for r in rows}
    ends = [("a" * 300 + end,) for end in ("b", "c", "b ?!")]
    hashes = [r[0] for r in spark.createDataFrame(ends, "q string").select(text.question_hash(F.col("q"))).collect()]
    assert hashes == [plain_hash(q) for q, in ends] and hashes[0] == hashes[2] != hashes[1]


def rows_of(spark, sf_dir, name):
    return Counter(tuple(r) for r in queries()[name](spark, sf_dir).collect())


def test_watermarks_of_all_events(spark, sf_dir):
    latest = {}
    for r in table(sf_dir, "events", "event_type", "ts"):
        if r["ts"] <= dt.datetime(2024, 1, 30, 23):
            source = "error" if r["event_type"] == "click" else r["event_type"]
            latest[source] = max(latest.get(source, r["ts"]), r["ts"])
    got = {r.source: r.watermark for r in queries()["source_watermarks_all"](spark, sf_dir).collect()}
    assert got == {x: latest.get(x) for x in ("click", "error", "purchase", "signup", "view")}


def test_greedy_dedup_of_all_lines(spark, sf_dir):
    lines = defaultdict(list)
    for r in table(sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"):
        lines[r["l_suppkey"] % 40, r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"]))
    used, kept = defaultdict(set), Counter()
    for line, order, packet, part in sorted((min(a for a, _ in x), o, p, min(b for _, b in x)) for (p, o), x in lines.items()):
        keys = {f"o{order % 50}", f"p{part % 60}"}
        if not keys & used[packet]:
            used[packet] |= keys
            kept[packet, order, line, part] += 1
    assert rows_of(spark, sf_dir, "greedy_dedup_all") == kept


def test_decisions_on_all_candidates(spark, sf_dir):
    asked, expected = defaultdict(list), {}
    for r in table(sf_dir, "events", "event_id", "user_id", "event_type", "value"):
        sure = Decimal(repr(min(1.0, 0.6 + r["value"] / 100))).quantize(Decimal("0.01"), ROUND_HALF_UP)
        asked[r["user_id"]].append((-sure, r["event_id"], r["event_type"] != "view"))
    for user, found in asked.items():
        (best, subject, eligible), *rest = sorted(found)
        gap = rest[0][0] - best if rest else None
        outcome = "ambiguous" if not eligible else ("commit" if -best >= Decimal("0.72") else "ambiguous") if gap is None else "tied" if gap == 0 else "commit" if -best >= Decimal("0.88") and gap >= Decimal("0.12") else "ambiguous"
        expected[user] = (outcome, subject if outcome == "commit" else None, float(-best), None if gap is None else float(gap))
    assert {r.request: tuple(r)[1:] for r in queries()["commit_decisions_all"](spark, sf_dir).collect()} == expected


def test_all_events_ask(spark, sf_dir):
    rows, newest = table(sf_dir, "events", "event_id", "user_id", "event_type", "ts"), {}
    key = lambda r: (r["user_id"] % 40, r["event_id"] % 2, r["event_type"])
    for r in sorted(rows, key=lambda r: (r["ts"], -r["event_id"])):
        if r["ts"] >= dt.datetime(2024, 1, 28):
            newest[key(r)] = (r["event_id"], r["ts"])
    expected = Counter((r["event_id"], r["user_id"] % 40, *newest[key(r)]) for r in rows if key(r) in newest)
    assert len(expected) > 100 and rows_of(spark, sf_dir, "answer_reuse_all") == expected


def test_all_events_are_lifted(spark, sf_dir):
    expected = {}
    for r in table(sf_dir, "events", "event_id", "user_id", "event_type", "value"):
        outcome = {"view": "absent", "purchase": "ambiguous"}.get(r["event_type"], "lifted")
        expected[r["event_id"]] = (r["user_id"] % 9, outcome, *((f"u{r['user_id']}", pytest.approx(r["value"] / 1000 * 0.85, abs=1e-9)) if outcome == "lifted" else (None, None)))
    got = {r.subject: (r.request, r.outcome, r.parent, r.confidence) for r in queries()["parent_lift_all"](spark, sf_dir).collect()}
    assert got == expected


def test_requests_meet_one_result_of_a_key(spark, monkeypatch):
    met, plain = [], stores.first_per_key
    monkeypatch.setattr(stores, "first_per_key", lambda df, *a: met.append(df.count()) or plain(df, *a))
    at = dt.datetime(2024, 1, 1)
    results = spark.createDataFrame([(i, "q", 1, "w", at + dt.timedelta(minutes=i // 2)) for i in range(50)], "result_id int, question string, epoch int, watermark string, created_at timestamp_ntz")
    asked = spark.createDataFrame([(i, "q", 1, "w") for i in range(20)], "request_id int, question string, epoch int, watermark string")
    got = stores.reusable(results, ["question"], asked, at, dt.timedelta(days=1)).collect()
    assert {(r.request_id, r.result_id) for r in got} == {(i, 48) for i in range(20)} and max(met) == 50


def test_only_first_rows_of_equal_keys_are_folded(spark):
    rows = [("p", i, f"a{i % 3}", None if i % 2 else f"b{i % 5}") for i in range(300)] + [("p", 300 + i, None, None) for i in range(3)]
    df, args = spark.createDataFrame(rows, "p string, id int, a string, b string"), (["p"], [F.col("id")], [F.col("a"), F.col("b")])
    used, kept = set(), []
    for _, i, *keys in rows:
        keys = {k for k in keys if k}
        if not keys & used:
            used |= keys
            kept.append(i)
    assert ranking.first_of_equal_keys(df, *args).count() == 3 + 15 + 3
    assert sorted(r.id for r in ranking.greedy_distinct(df, *args).collect()) == kept
