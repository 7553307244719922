"""Near copies of vectors and texts against all pairs compared."""

import numpy as np
import pytest

from tests.llm.conftest import ROWS
from tidemark.llm import jaccard, near_vectors
from tidemark.llm.components import connected_components
from tidemark.llm.workspace import Workspace

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Workspace(spark, "t"), "t").collect()
    ids = {x for e in edges for x in e}
    expected = {i: c for i, c in plain_components(ids, edges).items() if i != c}
    assert {r.id: r.component for r in got} == expected


def words_set(text, n):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def all_pairs(rows, n, percent):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, words_set(text, n))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return plain_components(ids, links), sets


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, n, percent):
    rng = np.random.default_rng(n)
    base = [[f"w{x}" for x in rng.integers(0, 4000, size)] for size in (30, 60, 120, 400)]
    rows = []
    for b in base:
        for k in range(25):
            words = list(b)
            for at in rng.integers(0, len(words), k % 6):
                words[at] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(f"z{x}" for x in rng.integers(0, 50, 12))) for k in range(60)]
    expected, sets = all_pairs(rows, n, percent)
    assert len(set(expected.values())) < len(rows) - 40
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Similarity(n, percent)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_blocks_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "block_rows", lambda band: 4)
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "QUERIES", 1)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(200)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(200, 1 + k % 9, replace=False):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    expected, _ = all_pairs(rows, 3, 90)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Similarity(3, 90)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


@pytest.mark.parametrize("lesser", [False, True])
def test_trees_find_all_that_reach_the_bound(lesser):
    rng = np.random.default_rng(4)
    tree = np.sort(rng.integers(0, 9, 400))
    tree = np.unique(tree, return_inverse=True)[1]
    centre = rng.integers(0, 3, (12, 64))
    counts = (centre[rng.integers(0, 12, 400)] + (rng.random((400, 64)) < 0.05)).astype(np.uint8)
    sizes, components = counts.sum(axis=1, dtype=np.int64), rng.integers(0, 60, 400)
    asking = rng.choice(400, 120, replace=False)
    forest = jaccard.CountForest(counts, tree, sizes, components)
    q, p = forest.search(counts[asking], tree[asking], sizes[asking], components[asking], 80 / 180, lesser)
    shared = np.minimum(counts[asking][:, None], counts[None]).sum(axis=2, dtype=np.int64)
    good = (shared >= 80 / 180 * (sizes[asking][:, None] + sizes[None]) - 1e-6) & (tree[asking][:, None] == tree[None])
    good &= (components[None] < components[asking][:, None]) if lesser else (components[None] != components[asking][:, None])
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(good)), strict=True))
    assert len(q) > 100


def test_folded_points_bound_the_intersection():
    rng = np.random.default_rng(6)
    one = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
    two = np.unique(np.concatenate([one[:90], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    band = jaccard.band_of(len(one))
    bits, fine = jaccard.group_bits(band), jaccard.fine_bits(band)
    groups = [jaccard.groups_of(jaccard.point(x)) >> (jaccard.fine_bits(jaccard.band_of(len(x))) - fine) for x in (one, two)]
    flat, starts = np.concatenate(groups), np.array([0, len(one), len(one) + len(two)])
    counts = jaccard.Points(flat >> (fine - bits), starts, bits).dense(np.arange(2))
    assert counts.sum(axis=1).tolist() == [len(one), len(two)]
    shared = len(np.intersect1d(one, two))
    assert shared <= np.minimum(counts[0], counts[1]).sum() < 110
    for left, right in ((0, 1), (1, 0)):
        assert shared <= jaccard.shared_at_most(flat, starts, np.array([left]), np.array([right]))[0] <= 94
    none = np.zeros(0, np.int64)
    assert not len(jaccard.shared_at_most(flat, starts, none, none))


def test_finer_groups_lose_no_shared_member():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(64, 90))) for _ in range(40)]
    groups = [jaccard.groups_of(jaccard.point(x)) >> (jaccard.fine_bits(jaccard.band_of(len(x))) - 9) for x in sets]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    one, other = rng.integers(0, 40, (2, 500))
    got = jaccard.shared_at_most(np.concatenate(groups), starts, one, other)
    assert all(n >= len(np.intersect1d(sets[i], sets[k])) for n, i, k in zip(got, one, other, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_all_verified_pairs_come_out_of_trees(spark, monkeypatch, n, percent):
    """On real documents: what is verified is what ``tree_pairs`` gave, and it joins all that links."""
    given, asked = [], []
    pairs, check = jaccard.tree_pairs, jaccard.verified

    def watched(*a, **k):
        out = pairs(*a, **k)
        given.append({tuple(r) for r in out.collect()})
        return out

    monkeypatch.setattr(jaccard, "tree_pairs", watched)
    monkeypatch.setattr(jaccard, "verified", lambda p, *a: asked.append({tuple(r) for r in p.collect()}) or check(p, *a))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = jaccard.jaccard_components(docs, jaccard.Similarity(n, percent))
    assert len(given) == 3 and given[0] and asked == given
    expected, _ = all_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == expected


def test_repeated_ids_are_documents_of_their_own(spark):
    words = [f"w{x}" for x in range(60)]
    near = [*words[:59], "other"]
    clean = [f"c{x}" for x in range(40)]
    rows = [(1, " ".join(words)), (1, " ".join(clean)), (2, " ".join(near)), (3, " ".join(clean)), (3, " ".join(near)), (4, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(1, 36, 1), (1, 56, 1), (2, 56, 1), (3, 36, 1), (3, 56, 1), (4, 56, 1)]
    assert sorted(tuple(r) for r in jaccard.one_of_each_group(docs).collect()) == sorted(rows[:2])


def test_jaccard_edge_cases(edge, empty):
    rows = jaccard.jaccard_components(edge).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].component_id == 1 and by_id[3].n_shingles == 0 and by_id[3].component_id == 3 and by_id[6].n_shingles == 1
    assert by_id[None].component_id is None
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.one_of_each_group(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10]
    assert jaccard.one_of_each_group(empty).count() == 0


def vectors(rng):
    centres = rng.standard_normal((30, 16))
    rows = []
    for k in range(400):
        v = centres[k % 30] + 0.12 * rng.standard_normal(16) if k % 3 else rng.standard_normal(16)
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 4)))
    for k in range(150):  # one group larger than a window
        rows.append((1000 + k, [float(np.float32(x)) for x in centres[0] + 0.05 * rng.standard_normal(16)], 1))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(40)]  # exact copies
    return rows


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 50)
    rows = vectors(np.random.default_rng(2))
    ids, x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    expected = plain_components(ids.tolist(), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors.near_vectors(df, near_vectors.Passes(window=16)).collect()
    assert {r.vec_id: r.component_id for r in got} == expected
    assert {r.vec_id: r.n_links for r in got} == dict(zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], 2, "x"), (4, [1.0, 0.0], None, "x"), (5, None, 1, "x"),
        (6, [0.0, 0.0], 1, "x"), (7, [1.0, None], 1, "x"), (8, [inf, 0.0], 1, "x"), (9, [nan, 0.0], 1, "x"), (10, [], 1, "x"), (11, [1.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (12, [1e-30, 0.0], 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    got = near_vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    links = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert links[1] == (3, 1) and links[2] == (3, 1) and links[12] == (3, 1)
    assert all(links[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and links[None] == (0, None)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_bridge_nothing(spark):
    rows = [(3, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (5, [0.0, 1.0], 2), (9, [0.1, 1.0], 2), (5, [-1.0, 0.0], 1), (2, [0.1, 1.0], 2), (5, [1.0, 0.1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect())
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (5, 2, 2, False), (9, 2, 2, False), (2, 2, 2, True), (5, 0, 5, True)])


def test_near_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    common = rng.standard_normal(64)
    common /= np.linalg.norm(common)
    x = np.sqrt(0.85) * common + np.sqrt(0.15 / 64) * rng.standard_normal((2400, 64))
    x[1200:] = x[:1200] + np.sqrt(0.11 / 64) * rng.standard_normal((1200, 64))  # a pair each at about 0.93 and more
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.945
    np.fill_diagonal(near, False)
    expected = plain_components(range(len(x)), list(zip(*(e.tolist() for e in np.nonzero(near)), strict=True)))
    assert len(x) - len(set(expected.values())) > 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df, near_vectors.Passes(least_cosine=0.945, window=8)).collect()
    assert {r.vec_id: r.component_id for r in got} == expected
