"""The two classifiers on held-out labels, and the language model against a plain one."""

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tidemark.llm import classify, factorisation, katz, positive_unlabelled, queries

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held_out_table(scores, labels, column):
    rows = scores.join(labels.filter(F.col(column).isNotNull()), "doc_id").filter("held_out").groupBy(column, "predicted").count().collect()
    return {(r[0], r[1]): r[2] for r in rows}


def test_quality_on_held_out_labels(spark, labels):
    got = held_out_table(queries.op2_factorisation_quality(spark, SF), labels, "quality")
    right = got.get((1, 1), 0) + got.get((0, 0), 0)
    assert right / sum(got.values()) > 0.97
    assert got.get((1, 0), 0) <= 0.01 * (got[1, 1] + got.get((1, 0), 0))


def test_toxicity_on_held_out_labels(spark, labels):
    got = held_out_table(queries.op6_pu_toxicity(spark, SF), labels, "toxic")
    assert got[1, 1] / (got[1, 1] + got[1, 0]) > 0.8
    assert got.get((0, 1), 0) / (got[0, 0] + got.get((0, 1), 0)) < 0.02


def plain_risk(weights, x, positive, prior):
    """Both terms by their definition, document by document."""
    g = x @ weights
    loss = lambda v: math.log1p(math.exp(-v))
    of_p = [(loss(v), loss(-v)) for v in g[positive]]
    first = prior * sum(a for a, _ in of_p) / len(of_p)
    return first, sum(loss(-v) for v in g[~positive]) / (~positive).sum() - prior * sum(b for _, b in of_p) / len(of_p)


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_and_slope_equal_the_definition(prior):
    rng = np.random.default_rng(1)
    x, positive = rng.normal(size=(60, 5)), rng.random(60) < 0.4
    weights = rng.normal(size=5)
    value, slope = positive_unlabelled.risk(x @ weights, positive, prior, 0.0)
    first, second = plain_risk(weights, x, positive, prior)
    assert value == pytest.approx(first + max(0.0, second))
    which = (lambda w: sum(plain_risk(w, x, positive, prior))) if second >= 0 else (lambda w: -plain_risk(w, x, positive, prior)[1])
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert (x.T @ slope)[k] == pytest.approx((which(weights + step) - which(weights - step)) / 2e-6, rel=1e-4, abs=1e-7)


def test_the_turned_slope_is_reached():
    g, positive = np.full(20, 3.0), np.arange(20) < 10
    g[10:] = -6.0
    value, slope = positive_unlabelled.risk(g, positive, 0.8, 0.0)
    assert value == pytest.approx(0.8 * math.log1p(math.exp(-3))) and (slope[positive] > 0).all() and (slope[~positive] < 0).all()


def test_prior_from_scores():
    rng = np.random.default_rng(5)
    positives, negatives = rng.normal(2, 1, 4000), rng.normal(-2, 1, 17000)
    got = positive_unlabelled.share_above(positives[:1000], np.concatenate([positives[1000:], negatives]), 0.3)
    assert abs(got - 0.15) < 0.03


def test_held_out_is_crc32_of_the_text_of_the_id(spark):
    rows = spark.range(50).withColumn("h", classify.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_classifiers_on_edge_cases(spark, edge, empty):
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, 0, None), (9, None, 1), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    quality = classify.fit_quality(edge, marks, factorisation.FMSettings(passes=2), ("n_chars",))
    toxic = classify.fit_toxicity(edge, marks, positive_unlabelled.PUSettings(passes=5))
    for model, meta in ((quality, ("n_chars",)), (toxic, ())):
        rows = classify.scored(edge, model, 0.5, meta).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert classify.scored(empty, model, 0.5, meta).count() == 0
    assert classify.kept_below(edge, toxic, 2.0).columns == edge.columns
    assert classify.kept_below(edge, toxic, 2.0).count() == len(ROWS)
    none = classify.fit_quality(empty, marks.limit(0), factorisation.FMSettings(), ("n_chars",))
    assert {r.score for r in classify.scored(edge, none, 0.5, ("n_chars",)).collect()} == {0.5}
    none = classify.fit_toxicity(empty, marks.limit(0), positive_unlabelled.PUSettings())
    assert all(r.score < 0.5 for r in classify.scored(edge, none, 0.5).collect())


def test_interactions_equal_the_double_sum():
    rng = np.random.default_rng(0)
    model = factorisation.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)), np.zeros(1), np.ones(1), factorisation.FMSettings())
    x = rng.normal(size=9)
    plain = 0.3 + model.linear @ x + sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(model.raw(np.zeros(9, np.int64), np.arange(9), x, 1)[0] - plain) < 1e-9


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_katz(rows, others=None):
    """Scores of ``rows`` under the model of those not held out, or of ``others`` under that of all ``rows``."""
    split = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    texts = [split(t) for _, t in rows]
    held = [others is None and zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    grams = [Counter(), Counter(), Counter()]
    for tokens, out in zip(texts, held, strict=True):
        if not out:
            padded = ["<start>", "<start>", *tokens]
            grams[0].update(tokens)
            grams[1].update(zip(padded[1:], tokens, strict=False))
            grams[2].update(zip(padded, padded[1:], tokens, strict=False))
    words = grams[0]
    cuts = [katz.Discounts.of([Counter(g.values())[r] for r in range(1, 7)]) for g in grams]
    cut = lambda k, c: c * cuts[k].factors[c - 1] if c <= 5 else c
    total = sum(words.values())
    kept = sum(cut(0, c) for c in words.values())
    unknown = max(1 - kept / total, 1 / (total + 1)) if total else 1.0
    after = defaultdict(list)
    for k in (1, 2):
        for gram, c in grams[k].items():
            after[gram[:-1]].append((gram[-1], c))

    @cache
    def context(h):
        n, k = sum(c for _, c in after[h]), len(h)
        all_above = all(c > 5 for _, c in after[h])
        free = 1 / (n + 1) if all_above else 1 - sum(cut(k, c) for _, c in after[h]) / n
        return n, all_above, free / (1 - sum(p(x, h[1:]) for x, _ in after[h]))

    def p(w, h):
        if not h:
            return cut(0, words[w]) * (1 - unknown) / kept if words[w] else unknown
        if h not in after:
            return p(w, h[1:])
        n, all_above, weight = context(h)
        c = grams[len(h)][*h, w]
        if c:
            return c / (n + 1) if all_above else cut(len(h), c) / n
        return weight * p(w, h[1:])

    if others is not None:
        rows, texts, held = others, [split(t) for _, t in others], [True] * len(others)
    scores = []
    for (i, _), tokens, out in zip(rows, texts, held, strict=True):
        padded = ["<start>", "<start>", *tokens]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens)
        scores.append((i, out, len(tokens), sum(words[w] > 0 for w in tokens), total, base, sum(math.log10(p(w, tuple(padded[k : k + 2]))) for k, w in enumerate(tokens))))
    return scores, p, words, after


def agree(got, expected):
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_katz_against_a_plain_model_and_sums_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected, p, words, after = plain_katz([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    agree(katz.katz_scores(docs).collect(), expected)
    seen = [h for h in after if len(h) == 2]
    for h in [("<start>", "<start>"), ("<start>",), *seen[:3], (seen[5][1],), (b"never seen", seen[9][1])]:
        assert sum(p(w, h) for w in words) + p(b"never seen", h) == pytest.approx(1)


def test_a_stored_model_scores_another_table(spark, edge, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 3 = 0")
    others = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 3 = 1").select("doc_id", "text").unionByName(edge.filter("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text"))
    katz.fit(docs).write(str(tmp_path / "model"))
    got = katz.scored_by(katz.Model.read(spark, str(tmp_path / "model")), others)
    expected, *_ = plain_katz([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in others.collect()])
    agree(got.collect(), expected)


def test_katz_on_edge_cases_in_small_chunks(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(katz, "LEAST_TOKENS", 50)
    monkeypatch.setattr(katz, "MESSAGE_TOKENS", 3)
    docs = edge.filter("doc_id IS NULL OR doc_id <> 7").repartition(1)
    docs = docs.unionByName(docs.filter("doc_id = 1").selectExpr("100 AS doc_id", *docs.columns[1:]))
    expected, *_ = plain_katz([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    agree(katz.katz_scores(docs).collect(), expected)
    assert katz.katz_scores(edge).count() == len(ROWS)
    assert katz.katz_scores(empty).count() == 0


def test_discounts_fall_back_where_counts_of_counts_fail():
    assert all(0 < x < 1 for x in katz.Discounts.of([10, 0, 0, 0, 0, 0]).factors)
    assert all(0 < x < 1 for x in katz.Discounts.of([0] * 6).factors)
    assert katz.Discounts.of([1000, 400, 200, 120, 80, 60]).factors[0] < 1
