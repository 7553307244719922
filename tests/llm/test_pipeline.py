"""The pipeline's stages as a chain, each recounted from what the one before it left."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_pairs import all_pairs
from tidemark.llm import mixing, packing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def after(spark):
    """Rows after each stage, as ``run`` chains them, by stage."""
    kept, stages = {}, corpus_pipeline.STAGES

    def watched(name, stage):
        def call(spark, docs, sf_dir):
            kept.setdefault("start", [r.asDict() for r in docs.collect()])
            kept[name + ":in"] = docs.columns
            out = stage(spark, docs, sf_dir)
            out = spark.createDataFrame(out.collect(), out.schema)
            kept[name] = [r.asDict() for r in out.collect()]
            return out

        return name, call

    corpus_pipeline.STAGES = [watched(*s) for s in stages]
    try:
        kept["run"] = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    finally:
        corpus_pipeline.STAGES = stages
    return kept


def test_toxic_rows_go_and_only_they(spark, after):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after["toxicity"]}
    clean = [r["doc_id"] for r in after["start"] if toxic.get(r["doc_id"]) == 0]
    assert len(left & set(clean)) >= 0.98 * len(clean)
    assert len(after["toxicity"]) < len(after["start"])
    assert all(r in after["start"] for r in after["toxicity"][:50])


def test_one_of_each_group_stays(after):
    groups, _ = all_pairs([(r["doc_id"], r["text"]) for r in after["toxicity"]], 5, 80)
    assert {r["doc_id"] for r in after["near_copies"]} == {i for i, g in groups.items() if i == g}


def test_spans_are_replaced_and_no_row_goes(after):
    before = {r["doc_id"]: r for r in after["near_copies"]}
    assert len(after["personal_data"]) == len(before)
    for r in after["personal_data"]:
        text = before[r["doc_id"]]["text"]
        assert r["text"] == (None if text is None else pii.redact(text, pii.find_spans(text)))


def test_copies_follow_the_mix(spark, after):
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in after["personal_data"]}
    source = {r["doc_id"]: r["source"] for r in after["personal_data"]}
    copies = Counter(r["doc_id"] for r in after["mix"])
    assert max(copies.values()) <= 2 and all(sizes[i] for i in copies)
    of, taken = Counter(), Counter()
    for i, n in sizes.items():
        of[source[i]] += n
        taken[source[i]] += n * copies[i]
    names = sorted(of, key=lambda s: (s is None, s or ""))
    largest = max(sizes.values())
    for name, target in zip(names, mixing.source_targets([(s, of[s]) for s in names], mixing.Mix()), strict=True):
        assert abs(taken[name] - target) <= largest


def test_pieces_hold_each_copy_whole(after):
    tokenizer = packing.public_byte_pairs()
    plain = packing.BytePairs(tokenizer.path)
    rows = {r["doc_id"]: r["text"] for r in after["mix"]}
    copies = Counter(r["doc_id"] for r in after["mix"])
    lengths, places = defaultdict(int), defaultdict(list)
    for r in after["run"]:
        lengths[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(lengths[i] == copies[i] * (len(plain.ids(rows[i] or "")) + 1) for i in copies) and set(lengths) == set(copies)
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
