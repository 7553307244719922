"""Boundary cases that the star-schema tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity, text
from tidemark.functions.vocabulary import category_rule
from tidemark.operators import aggregates, facts, graph, paging, ranking, search, temporal, versions
from tidemark.plans import packet
from tidemark.plans.queries import queries
from tidemark.plans.statements import oracle_sql

T0 = dt.datetime(2024, 1, 1)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_version_tie_is_broken_by_the_named_column(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, v int, id string")
    assert ids(versions.latest_version(df, ["k"], "v", ["id"])) == ["y", "z"]


def test_validity_is_half_open_and_null_is_unbounded(spark):
    df = spark.createDataFrame([(1, T0, T0 + dt.timedelta(1)), (2, None, None), (3, T0, None)], "id int, f timestamp_ntz, t timestamp_ntz")
    at = lambda t: ids(df.filter(temporal.valid_at(F.col("f"), F.col("t"), temporal.stamp(t))))
    assert at(T0) == [1, 2, 3] and at(T0 + dt.timedelta(1)) == [2, 3] and at(T0 - dt.timedelta(1)) == [2]


def test_inverted_windows_collapse_to_their_start(spark):
    df = spark.createDataFrame([(5, 9, 1, 3), (1, None, 2, 4)], "a int, b int, c int, d int")
    start, end = temporal.intersect_validity((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
    assert [tuple(r) for r in df.select(start, end).collect()] == [(5, 5), (2, 4)]


def test_a_null_end_survives_the_fold(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 3, None), ("j", 1, None), ("j", 2, 7)], "k string, f int, t int")
    assert {r.k: (r.f, r.t) for r in versions.fold_ownership(df, ["k"], "f", "t").collect()} == {"k": (1, None), "j": (1, 7)}


def test_greedy_dedup_lets_dropped_rows_claim_nothing(spark):
    df = spark.createDataFrame([("p", 1, "k1", "k2"), ("p", 2, "k2", "k3"), ("p", 3, "k3", None)], "p string, id int, a string, b string")
    assert ids(ranking.greedy_distinct(df, ["p"], [F.col("id")], [F.col("a"), F.col("b")])) == [1, 3]


def test_quota_remainder_goes_to_the_first_categories():
    assert list(ranking.quotas(7).values()) == [2, 2, 1, 1, 1]


def test_packing_skips_or_stops(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 2, 9), ("p", 3, 2)], "p string, id int, cost int")
    assert ids(ranking.pack_skipping(df, ["p"], "id", "cost", 8)) == [1, 3]
    assert ids(ranking.pack_stopping(df, ["p"], "id", "cost", 8)) == [1]


def test_goal_words_count_twice_and_short_ones_do_not(spark):
    df = spark.createDataFrame([("a fix", "it")], "c string, l string")
    assert df.select(ranking.goal_score(F.col("c"), F.col("l"), "fix fix to")).collect()[0][0] == 2


def test_unsigned_values_beyond_a_long_are_left_out(spark):
    df = spark.sql("SELECT CAST('18446744073709551615' AS DECIMAL(20,0)) AS v, 's' AS s UNION ALL SELECT CAST(7 AS DECIMAL(20,0)), 't'")
    assert [r.subject_id for r in facts.long_facts(df, "k", F.col("s"), {"v": facts.representable(F.col("v"))}).collect()] == ["t"]


def test_a_tombstone_older_than_the_row_spares_it(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "id int, observed int")
    dead = spark.createDataFrame([(1, 9), (2, 10)], "id int, effective int")
    assert ids(graph.apply_tombstones(rows, dead, ["id"], "observed", "effective")) == [1, 3]


def test_stubs_stay_while_an_edge_touches_them(spark):
    nodes = spark.createDataFrame([("a", "stub"), ("b", "stub"), ("c", "item")], "node_id string, kind string")
    edges = spark.createDataFrame([("c", "a")], "source_id string, target_id string")
    assert ids(graph.drop_orphans(nodes, edges, F.col("kind") == "stub"), "node_id") == ["a", "c"]


def test_keyset_pages_neither_skip_nor_repeat(spark):
    df = spark.createDataFrame([(T0, str(k)) for k in range(3)], "at timestamp_ntz, key string")
    first = paging.page(df, "at", "key", 2).collect()
    assert [r.key for r in first] == ["0", "1"] and all(r.truncated for r in first)
    rest = paging.page(df, "at", "key", 2, (temporal.stamp(T0), F.lit("1"))).collect()
    assert [r.key for r in rest] == ["2"] and not rest[0].truncated


def test_ties_with_the_kth_are_kept(spark):
    df = spark.createDataFrame([("g", 3), ("g", 2), ("g", 2), ("g", 1)], "g string, s int")
    assert ranking.top_with_ties(df, ["g"], "s", 2).count() == 3


@pytest.mark.parametrize(("scores", "cut", "outcome"), [([0.90, 0.79], False, "ambiguous"), ([0.90, 0.77], False, "commit"), ([0.95, 0.5], True, "ambiguous"), ([0.72], False, "commit"), ([0.9, 0.9], False, "tied")])
def test_gate(spark, scores, cut, outcome):
    df = spark.createDataFrame([("r", f"s{i}", s, cut) for i, s in enumerate(scores)], "r string, subject string, confidence double, cut boolean")
    assert search.commit_gate(df, ["r"], "subject", F.lit(True), F.col("cut")).collect()[0].outcome == outcome


def test_panel_tie_goes_to_the_least_value(spark):
    df = spark.createDataFrame([("q", "v1", "b"), ("q", "v2", "a")], "q string, voter string, value string")
    assert aggregates.consensus(df, ["q"], "voter", "value").collect()[0].majority == "a"


def test_question_forms_hash_alike(spark):
    df = spark.createDataFrame([("  What  is X?? ",), ("what is x",)], "q string")
    assert len({r[0] for r in df.select(text.question_hash(F.col("q"))).collect()}) == 1


def test_segments_round_trip(spark):
    df = spark.createDataFrame([("a%b:c", "x" * 300)], "s string, long string")
    made = identity.derive_id("k", F.col("s"))
    row = df.select(made.alias("id"), identity.id_segments(made).alias("seg"), identity.derive_id("k", F.col("long")).alias("none"), identity.deterministic_uuid(F.col("s")).alias("u")).collect()[0]
    assert row.id == "k.v2:a%25b%3Ac" and row.seg == ["a%b:c"] and row.none is None
    assert row.u[14] == "5" and row.u[19] in "89ab" and len(row.u) == 36


def test_time_is_checked():
    now = T0
    with pytest.raises(ValueError, match="future"):
        temporal.check_time("valid_time", now, now + dt.timedelta(minutes=2))
    with pytest.raises(ValueError, match="range"):
        temporal.check_time("range", now, now - dt.timedelta(days=500), now)
    assert temporal.check_time("valid_time", now, now + dt.timedelta(seconds=30)) == (now, None)


def test_evidence_may_name_a_rule_and_a_claim_of_its_own(spark):
    rows = [("Incident", "team.rule", "inferred"), ("commit", " ", "inferred"), ("task", "r" * 241, "inferred"), ("release", "x", "observed"), ("other", None, None)]
    got = spark.createDataFrame(rows, "t string, r string, c string").select(category_rule(F.col("t"), F.col("r"), F.col("c")).alias("x")).select("x.*").collect()
    assert [(r.rule_id, r.claim, r.category) for r in got] == [
        ("team.rule", "inferred", "pressure"), ("evidence.observed.cause.v1", "observed", "cause"), ("evidence.observed.action.v1", "observed", "action"),
        ("evidence.observed.state.v1", "observed", "state"), ("evidence.observed.reference.v1", "observed", "evidence"),
    ]


def test_evidence_rules_name_what_is_broken(spark):
    row = ("ref-00001", "s", "commit", "e", "l", "", "native", 0.5, "c", T0)
    names = "evidence_ref_id string, system string, entity_type string, entity_id string, display_label string, safe_uri string, provenance string, confidence double, citation string, observed_at timestamp_ntz"
    bad = [(*row[:6], "", *row[7:]), (*row[:7], 1.5, *row[8:]), ("short", *row[1:]), (*row[:9], None), (*row[:5], "no scheme", *row[6:])]
    got = spark.createDataFrame([row, *bad], names).select(packet.broken_rule()).collect()
    assert [r[0] for r in got] == [None, "provenance", "confidence", "id", "observed_at", "uri"]


def test_limitations_displace_only_model_authored_ones():
    full = [("a", True), ("m", False), ("b", True)]
    assert ranking.displace(full, "new", 3) == ([("a", True), ("b", True), ("new", True)], 1)
    assert ranking.displace([("a", True)], "new", 1) == ([("a", True)], 1)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_statement(spark, sf_dir, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    expected, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)

    def rows(frame):
        plain = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) or not isinstance(v, (int, float)) else f"{float(v):.9g}"
        return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(expected)
