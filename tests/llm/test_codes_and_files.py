"""Token files, fill-in-the-middle and vector codes on edge cases and against plain recounts."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm.conftest import LONG, ROWS
from tidemark.llm import fill_in_middle, token_files, vector_codes

WORDS = "public"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = [
    "It's DON'T we'll o'clock.'s", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>", "á é ́x .̸ ≠", "ΑΣ ΣΑΣ İI ǅ ﬁ", "a b c　d\u0085e", "3.14,15 x=1;y=2!!! ((a)) --b-- c…",
    "東京☕️ naïve—ÉCOLE", "\x00\x01 a\x1cb", "word,.;:!?" * 3, "", "  \t\n", "'s 't x's. x'.", "a" * 200 + ". " + "é" * 100,
]


@pytest.mark.parametrize("text", ODD)
def test_ids_by_word_are_those_of_the_whole_text(tokenizer, text):
    got = token_files.public_word_pieces().ids(text.encode())
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbZ0'.,!? \n\tsé̸́=<|>ßΣİ☕東-_%#")), max_size=40))
def test_ids_by_word_hold_for_any_text(tokenizer, text):
    got = token_files.public_word_pieces().ids(text.encode())
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_leave_memory_without_a_change(tokenizer):
    small = token_files.WordPieces(public_tokenizers.path("word_bpe_49k.json"), by_word=True, memory=8)
    text = " ".join(f"word{i % 37}, other{i % 11}" for i in range(500))
    for _ in range(3):
        assert np.frombuffer(small.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def plain_ids(tokenizer, rows, end=2):
    """(doc_id, start, n_tokens, crc) in ascending doc_id, rows without one first."""
    out, at = [], 0
    made = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]
    for doc, ids in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, edge, empty, tokenizer):
    got = sorted((tuple(r) for r in token_files.round_trip(edge, token_files.public_word_pieces(), layout=token_files.Layout(text_bytes=50_000)).collect()), key=lambda r: r[1])
    assert got == plain_ids(tokenizer, [(r[0], r[1]) for r in ROWS])
    assert token_files.round_trip(empty, token_files.public_word_pieces()).count() == 0


def test_many_rows_without_an_id_spread_over_files(spark, tmp_path):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'the very same text', concat('text ', id)) AS text")
    made = token_files.write_tokens(docs, f"file://{tmp_path}/t", token_files.public_word_pieces(), layout=token_files.Layout(text_bytes=4000))
    per_file = made.tokens().groupBy("part").agg(F.count_if(F.col("doc_id").isNull()).alias("n")).collect()
    assert len(per_file) > 5 and max(r.n for r in per_file) < 600
    rows = sorted((tuple(r) for r in made.digest().collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert all(b[1] == a[1] + a[2] for a, b in zip(rows, rows[1:]))


def test_files_carry_indexes_and_are_pruned_by_them(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id * 2 AS doc_id", "concat('some words of document ', id) AS text")
    layout = token_files.Layout(text_bytes=1 << 30, stripe_bytes=64 << 10, stride=1000)
    made = token_files.write_tokens(docs, f"file://{tmp_path}/t", token_files.public_word_pieces(), layout=layout)
    (file,) = (tmp_path / "t" / "tokens").glob("*.orc")
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    stripes = reader.getStripes()
    assert stripes.size() > 3 and reader.getRowIndexStride() == 1000
    footer = reader.rows().readStripeFooter(stripes.get(0))
    kinds = {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    encodings = {str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())}
    assert encodings <= {"DIRECT", "DIRECT_V2"} and "DIRECT_V2" in encodings

    def rows_read(df):
        out = df.select("doc_id", F.size("ids").alias("n"))
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        total = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        return got, total

    got, read = rows_read(made.find([4000, 4001, 39_998]))
    assert sorted(r.doc_id for r in got) == [4000, 39_998] and read < 5000
    got, read = rows_read(made.find([4001]))  # inside a stripe's range, but in no Bloom filter
    assert got == [] and read < 3000
    got, read = rows_read(made.between(10_000, 10_100))
    assert len(got) == 51 and read < 5000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(file.stat().st_size // 4))
    try:
        sizes = made.tokens().groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) > 2 and sum(r["count"] for r in sizes) == 20_000  # several stripes, several tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stretches_of_the_sequence(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 7 AS INT)) AS text")
    made = token_files.write_tokens(docs, f"file://{tmp_path}/t", token_files.public_word_pieces(), layout=token_files.Layout(text_bytes=500))
    rows = sorted((tuple(r) for r in made.digest().collect()), key=lambda r: r[1])
    got = {r.doc_id: r.start for r in made.stretch(100, 160).collect()}
    assert got == {d: s for d, s, n, _ in rows if s < 160 and s + n > 100}


# ---- fill in the middle


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=200), st.data())
def test_ranked_bits_are_found_by_halving(bits, data):
    mask = sum(1 << i for i, b in enumerate(bits) if b)
    at = [i for i, b in enumerate(bits) if b]
    ranks = sorted(data.draw(st.lists(st.integers(0, max(0, len(at) - 1)), max_size=3))) if at else []
    assert fill_in_middle.select(mask, len(bits), ranks) == [at[r] for r in ranks]


def plain_middle(doc, text, seed=1):
    """As the form is defined, on code points."""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.integers(-5, 10**12), st.text(alphabet=st.sampled_from(list("ab <>PSMé東☕\U0001f600\n\t́")), max_size=60))
def test_middles_are_cut_by_code_points(doc, text):
    cut = fill_in_middle.rearranged(text.encode(), doc)
    assert (cut.n, cut.form, cut.prefix_chars, cut.middle_chars, cut.output.decode()) == plain_middle(doc, text)
    assert fill_in_middle.restored(cut.output, cut.form).decode() == text


@given(st.text(alphabet=st.sampled_from(list("ab \n\té東")), max_size=40))
def test_words_and_lines_as_units(text):
    data = text.encode()
    starts = [i for i in range(len(data)) if data[i : i + 1] not in b" \t\n\v\f\r" and (i == 0 or data[i - 1 : i] in b" \t\n\v\f\r")]
    mask = fill_in_middle.words(data)
    assert [i for i in range(len(data)) if mask >> i & 1] == sorted({*starts, 0} if data else set())
    assert fill_in_middle.lines(data).bit_count() == len(data.splitlines() if set(text) <= set("ab \n\té東") else [])
    for unit in ("words", "lines"):
        cut = fill_in_middle.rearranged(data, 3, fill_in_middle.Middle(transformed=100, unit=unit))
        assert fill_in_middle.restored(cut.output, cut.form) == data


def test_middles_on_edge_cases(edge, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(str, map(tuple, fill_in_middle.digest(edge).collect())))
    want = []
    for doc, text, *_ in ROWS:
        n, form, p, m, out = plain_middle(doc, text or "")
        want.append((doc, n, form, p, m, sha(out), sha(text or "")))
    assert got == sorted(map(str, want)) and any(len(LONG) == w[1] for w in want)
    texts = fill_in_middle.texts_again(fill_in_middle.fill_in_middle(edge)).collect()
    assert sorted(r.text for r in texts) == sorted(r[1] or "" for r in ROWS)
    assert fill_in_middle.digest(empty).count() == 0 and fill_in_middle.fill_in_middle(empty).count() == 0


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Lloyd's rounds in plain integers; rows: (vec_id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(v) for _, v, _ in kept), default=0)
    w = -(-longest // parts)
    cells = [[math.floor(256 * x) for x in v] + [0] * (w * parts - len(v)) for _, v, _ in kept]
    split = [[c[p * w : (p + 1) * w] for p in range(parts)] for c in cells]
    books = [[split[j][p] for j in range(min(entries, len(split)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(s[p], books[p])[1] for s in split]
            for j in range(len(books[p])):
                mine = [s[p] for s, o in zip(split, own) if o == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, label), s in zip(kept, split):
        best = [near(s[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
        sums[label] = sums.get(label, 0) + error
    return sorted((str((i, c, e, sums[label], sha)) for i, c, e, label in out))


def coded(df, **kinds):
    return sorted(str(tuple(r)) for r in vector_codes.vector_codes(df, **kinds).drop("label").collect())


def vectors_of(seed, n, d=32, scale=1.0, nulls=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d)) * scale
    rows = [(i, (centres[rng.integers(5)] + rng.normal(size=d) * 0.3 * scale).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]
    if nulls:
        rows += [(n, None, 1), (n + 1, [1.0, None] * (d // 2), 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("-inf")] * d, None), (n + 4, [0.0] * d, None), (None, rows[0][1], None), (3, rows[3][1], 2), (3, rows[5][1], 2)]
    return rows


@pytest.mark.parametrize("seed, n, scale", [(0, 400, 1.0), (1, 400, 1e-2), (2, 70, 1e6), (3, 20, 1.0)])
def test_codes_are_those_of_plain_rounds(spark, seed, n, scale):
    rows = vectors_of(seed, n, scale=scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).repartition(3)
    assert coded(df) == plain_codes([(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_more_rounds_and_small_chunks(spark, monkeypatch):
    rows = vectors_of(4, 300, nulls=False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2)
    monkeypatch.setattr(vector_codes, "CHUNK_COMPONENTS", 32 * 50)
    got = coded(df, settings=vector_codes.Codes(parts=4, entries=8, rounds=5))
    assert got == plain_codes([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows], 4, 8, 5)


def test_heaps_leave_most_parts_alone():
    """With entries that hardly move, few parts are compared again, and all codes stay exact."""
    rng = np.random.default_rng(6)
    book = rng.integers(-1000, 1000, (16, 4))
    points = book[rng.integers(16, size=5000)] + rng.integers(-40, 40, (5000, 4))
    own, slack = vector_codes.nearest(points, book)
    heaps, codes = vector_codes.Heaps.built(own, slack, 16), own.astype(np.uint8)
    drift = np.zeros(16)
    for _ in range(4):
        fresh = book + rng.integers(-3, 4, book.shape)
        gone = np.sqrt(((fresh - book) ** 2).sum(1))
        drift += gone + np.array([np.delete(gone, e).max() for e in range(16)])
        book = fresh
        _, taken = heaps.popped(drift)
        assert len(taken) < 2500
        heaps, _, _ = heaps.moved(points, codes, book, drift)
        assert (codes == ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
        assert sorted(heaps.members.tolist()) == list(range(5000))


def test_ties_equal_rows_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(i, [1.0] * 32, 0) for i in range(100)] + [(200, [float(2**40)] * 32, 1), (201, [], 1)]
    assert coded(spark.createDataFrame(rows[:100], kind)) == plain_codes(rows[:100])
    far = {r.vec_id: r for r in vector_codes.vector_codes(spark.createDataFrame(rows, kind)).collect()}
    assert len(far) == 102 and far[201].code and far[0].error == 0
    assert vector_codes.vector_codes(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
