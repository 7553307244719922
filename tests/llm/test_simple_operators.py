"""Sharding, personal data, repetition, mixing and packing on edge cases and against plain recounts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import LONG, ROWS
from tidemark.llm import mixing, packing, pii, repetition, shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_move_only_into_the_new_one(spark, edge):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    rows = shard.assign_shards(docs, [1.0] * 40).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    assert 30 < sum(r.grown_shard == 40 for r in rows) < 130
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    got = Counter(r.shard for r in shard.assign_shards(docs, [1.0, 3.0]).collect())
    assert 0.70 < got[1] / 4000 < 0.80


def test_shards_on_edge_cases(edge, empty):
    rows = shard.assign_shards(edge, [1.0] * 5).collect()
    assert len(rows) == len(ROWS)
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in rows}
    assert sizes[3] == (16, 0) and sizes[4] == (16, 0)
    assert sizes[7] == (16 + len(LONG), zlib.crc32(LONG.encode()))
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert shard.assign_shards(empty, [1.0] * 5).count() == 0


def test_spread_ranks_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(shard, "ROWS_PER_SPREAD", 10)
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text")
    rows = shard.assign_shards(docs, [1.0] * 2).collect()
    for s in (0, 1):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        digests = [hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in mine]
        assert digests == sorted(digests)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "a@b.c x@@y.z me.you+1@sub.example.org,two@x-y.io@z.com é@é.fr @a.b a@b",
    "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112 12345678901234567890 1 2 3",
    "+1 (499) 555-6503 +123 ++4420 7946 0958 +1-2-3 +1234567890123456",
    "☕ +49.30.901820, mail: ünï@example.com 10.0.0.1",
    "IBAN DE89370400440532013000 and DE89370400440532013001, account GB82 WEST 1234 5698 7654 32",
    "card 378282246310005 here; 378282246310005 there is no word near",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    found = [s[:3] for s in pii.find_spans(text)]
    assert [s for s in found if s[0] in pii.BASE_KINDS] == plain_base(text)


def test_checksums_confirm_and_context_adds():
    kinds = Counter(s[0] for s in pii.find_spans(TEXTS[5]))
    assert kinds["iban"] == 2
    near = [s for s in pii.find_spans(TEXTS[6]) if s[0] == "card_short"]
    assert near and near[0][1] == 5 and near[0][4]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_long_runs_stay_linear():
    text = "a" * 200_000 + " " + "1" * 200_000 + "." + "9" * 5000 + ".1.1 " + "@" * 1000
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == []


def test_digest_and_redaction(edge, empty):
    rows = {r.doc_id: r for r in pii.digest(edge).collect()}
    assert rows[9].n_email == 3 and rows[3].n_email == 0
    assert rows[3].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].spans == ""
    out = pii.redacted(edge)
    assert out.columns == edge.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[9].text.count("[EMAIL]") == 3 and texts[3].text is None and texts[9].n_chars == len(texts[9].text)
    assert pii.digest(empty).count() == 0 and pii.redacted(empty).count() == 0
    assert pii.redact("+1 (499) 555-6503 x", pii.find_spans("+1 (499) 555-6503 x")) == "[PHONE] x"


def plain_repetition(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_repetition_counts_and_edge_cases(edge, empty):
    rows = repetition.repetition_rules(edge).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text, *_ in ROWS:
        r = by_id[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_repetition(text or "")
        assert not (r.base_failed and r.kept)
    assert by_id[3].base_failed and by_id[1].kept and not by_id[9].kept
    assert repetition.repetition_rules(empty).count() == 0


def test_pivot_keeps_the_words_and_ends_integral():
    rng = np.random.default_rng(3)
    mass, chance = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    out, held = mixing.pivot(mass, chance, rng.random(500))
    rest = np.delete(out, held) if held >= 0 else out
    assert set(rest) <= {0.0, 1.0}
    assert abs((out * mass).sum() - (chance * mass).sum()) < 1e-6
    taken = np.mean([mixing.pivot(mass[:40], chance[:40], rng.random(40))[0] for _ in range(3000)], axis=0)
    assert np.abs(taken - 0.37).max() < 0.06


def test_targets_stop_at_twice_the_size():
    targets = mixing.source_targets([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], mixing.Mix())
    assert targets[0] == 20 and abs(sum(targets) - 1.5 * 2060) < 1e-9 and targets[3] == 100
    assert all(t <= 2 * n + 1e-9 for t, n in zip(targets, (10, 1000, 1000, 50), strict=True))


def test_mix_near_targets_in_a_tree(spark, monkeypatch, edge, empty):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 37 AS INT)) AS text", "IF(id % 3 = 0, 's' || id % 5, 'big') AS source")
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    assert sorted(rows) == sorted(again) and len(rows) == 3000
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r.taken <= 2 * r["size"] and r.taken % r["size"] == 0
        taken[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 37 for (_, t), v in taken.items())
    rows = mixing.mix_sources(edge).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.taken for r in rows}[3] == 0
    assert mixing.mix_sources(empty).count() == 0
    copies = mixing.mixed_documents(edge)
    assert copies.columns == edge.columns
    assert copies.count() == sum(r.copies for r in rows if r["size"])
    assert mixing.mixed_documents(empty).count() == 0


def test_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 40, 20), strict=True)}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [b for b in bins if b >= length]
                left = min(fits, default=64)
                if fits:
                    bins.remove(left)
                bins.append(left - length)
        placed, used = packing.best_fit(counts, 64), defaultdict(list)
        for length, _, n, first, offset in placed:
            for i in range(n):
                used[first + i].append((offset, length))
        assert len(used) == len(bins)
        assert sorted(64 - sum(n for _, n in x) for x in used.values()) == sorted(bins)
        for x in used.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length


def test_packing_round_trip(edge, empty):
    tokenizer = packing.public_byte_pairs()
    plain = packing.BytePairs(tokenizer.path)
    rows = packing.pack(edge, tokenizer).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text, *_ in ROWS:
        if doc_id == 2:
            assert len(by_doc[2]) == 2
            continue
        ids, at = [*plain.ids(text or ""), 2], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in by_doc[doc_id] if r.piece)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, tokenizer).count() == 0


def test_both_tokenizers_agree():
    tokenizer = packing.public_byte_pairs()
    plain = packing.BytePairs(tokenizer.path)
    for text in ["a<|endoftext|>b", "  two  spaces \n\n x", "naïve 東京 ☕   ½ 3rd don't I'LL", "\x00\x1f ", *(r[1] or "" for r in ROWS if r[0] != 7)]:
        assert tokenizer.ids(text) == plain.ids(text)
