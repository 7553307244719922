"""Katz back-off language model of order three: Good-Turing counts in partitioned tables, scored token by token.

Texts are encoded once in chunks.  At each order a chunk asks parts of the counts, one
entry for each distinct n-gram of the chunk: first the unigram parts for the ids and
counts of its words, then the bigram parts, dealt by the first word, then the trigram
parts, dealt by the first pair.  A part adds up what all chunks have in their training
texts, answers every chunk, and is stored; stored parts answer other texts likewise,
being one more chunk that asks nothing.  What follows a very common word or pair is
dealt over several parts.

A chunk and a part hold about the square root of MESSAGE_TOKENS x all tokens, so that a
message between the two has MESSAGE_TOKENS on average and the number of messages grows
in proportion to the tokens.  A chunk is no larger than an input partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import release, squeeze, unsqueeze
from .classify import remainder
from .words import LOWER, hashes, raw_texts
from .workspace import Workspace, ship_package

MESSAGE_TOKENS = 4000
LEAST_TOKENS = 50_000
TOKEN_BYTES = 6
END = np.uint64(0xE1D0E1D0E1D0E1D1)
START_ID = 0  # of the word and of the pair before a text
KEEP = 5  # counts above are not discounted
RANKS = [f"n{r}" for r in range(1, KEEP + 2)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def share_tokens(tokens: int) -> int:
    """Tokens of a chunk and of a part."""
    return max(LEAST_TOKENS, math.isqrt(MESSAGE_TOKENS * tokens))


@dataclass(frozen=True)
class Discounts:
    """Good-Turing factors for counts 1 to KEEP; greater counts keep theirs."""

    factors: tuple[float, ...]

    @classmethod
    def of(cls, ranks: list[int]) -> Discounts:
        """Katz's renormalised factors; where the counts of counts don't allow them
        (empty, or a factor outside (0, 1)), 1 - D / r with D = n1 / (n1 + 2 n2)."""
        n = [0, *ranks]
        share = (KEEP + 1) * n[KEEP + 1] / n[1] if n[1] else 1.0
        made = [((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share) if n[r] and share != 1 else 0.0 for r in range(1, KEEP + 1)]
        if not all(0 < x < 1 for x in made):
            d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            made = [1 - d / r for r in range(1, KEEP + 1)]
        return cls(tuple(made))

    def apply(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors, 1.0])
        return table[np.minimum(counts, KEEP + 1)] * counts

    def freed(self, per_rank: np.ndarray) -> np.ndarray:
        """Mass taken from contexts with so many continuations of each count up to KEEP."""
        return per_rank @ np.array([(1 - d) * r for r, d in enumerate(self.factors, 1)])


@dataclass(frozen=True)
class Unigrams:
    """The lowest level: discounted counts, and one unknown word that has what is left."""

    discounts: Discounts
    total: int
    types: int
    kept: float  # the sum of the discounted counts

    def probability(self, counts: np.ndarray) -> np.ndarray:
        unknown = max(1 - self.kept / self.total, 1 / (self.total + 1)) if self.total else 1.0
        scale = (1 - unknown) / self.kept if self.kept else 0.0
        return np.where(counts > 0, self.discounts.apply(counts) * scale, unknown)


@dataclass(frozen=True)
class Bigrams:
    """A level above: n-grams seen in training, by counts and those of their contexts."""

    discounts: Discounts

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """Of signed counts: discounted, or as they are, negative, where the context frees nothing."""
        return np.where(counts < 0, counts, self.discounts.apply(np.abs(counts)))

    @staticmethod
    def share(mass: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The probability that such a mass is after contexts of these counts."""
        return np.where(mass < 0, -mass / (contexts + 1), mass / np.maximum(contexts, 1))


CHUNKS = "chunk long, docs binary, nulls binary, held binary, lengths binary, words binary, tokens binary, n_tokens long, n_texts long"
CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def _chunk_row(chunk: int, part: pa.Table) -> pa.RecordBatch:
    single, lengths = [], []
    for t in raw_texts(part.column("text")):
        h = hashes(t.translate(LOWER).split())
        single += [h, END[None]]
        lengths.append(len(h) + 1)
    words, tokens = np.unique(np.concatenate(single), return_inverse=True)
    held = part.column("held_out").to_numpy().astype(np.uint8)
    ids, none = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_null().to_numpy()
    size = np.array(lengths, np.int64)
    row = [chunk, squeeze(ids), squeeze(none.astype(np.uint8)), squeeze(held), squeeze(size), words.tobytes(), squeeze(tokens.astype(np.int32)), int(size[held == 0].sum()), int((held == 0).sum())]
    release()
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=CHUNK_NAMES)


def _encoded(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk, waiting, held_bytes = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        at = 0
        while at < len(sizes):
            ends = held_bytes + np.cumsum(sizes[at:])
            n = int(np.searchsorted(ends, chunk_bytes))
            to = min(len(sizes), at + n + 1)
            waiting.append(batch.slice(at, to - at))
            held_bytes = int(ends[to - at - 1])
            if held_bytes >= chunk_bytes:
                yield _chunk_row(chunk, pa.Table.from_batches(waiting))
                chunk, waiting, held_bytes = chunk + 1, [], 0
            at = to
    if waiting:
        yield _chunk_row(chunk, pa.Table.from_batches(waiting))


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pandas().iloc[0]
            release()


def _message_batch(made: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) if made else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


WORD_QUESTIONS = "part int, chunk long, words binary, counts binary"
WORD_ANSWERS = "part int, chunk long, a binary, b binary, types long, total long, " + ", ".join(f"{r} long" for r in RANKS)


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        training = np.repeat(unsqueeze(row.held) == 0, unsqueeze(row.lengths))
        words = np.frombuffer(row.words, np.uint64)
        counts = np.bincount(unsqueeze(row.tokens)[training], minlength=len(words)).astype(np.int64)
        part = ((words >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        starts = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(starts))
        made = [(int(p), row.chunk, words[starts[p] : starts[p + 1]].tobytes(), squeeze(counts[starts[p] : starts[p + 1]])) for p in full]
        yield _message_batch(made, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["part", "chunk", "words", "counts"])


def _ranks(counts: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(np.minimum(counts, KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2]]


def _answer_words(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Count a part's words over all chunks; tell each chunk the ids and counts of its own.

    Words unseen in training are numbered last, so that the stored ones keep their ids
    whatever else is asked.
    """
    frame = frame.sort_values("chunk")
    part, asked = int(frame.part.iloc[0]), [np.frombuffer(x, np.uint64) for x in frame.words]
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unsqueeze(x) for x in frame.counts]), minlength=len(words)).astype(np.int64)
    known = counts > 0
    order = np.lexsort((words, -counts))  # frequent words get small ids
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ids = 1 + rank * parts + part
    ends = np.cumsum([len(x) for x in asked])
    nothing = [0] * (2 + len(RANKS))
    out = [[part, c, squeeze(ids[place[e - len(w) : e]]), squeeze(counts[place[e - len(w) : e]]), *nothing] for c, w, e in zip(frame.chunk, asked, ends, strict=True) if c >= 0]
    stored = order[: known.sum()]
    out.append([part, -1, words[stored].tobytes(), squeeze(counts[stored]), int(known.sum()), int(counts.sum()), *_ranks(counts)])
    return pd.DataFrame(out, columns=[c.split()[0] for c in WORD_ANSWERS.split(", ")])


NAMED = ", ".join(c for c in CHUNKS.split(", ") if c != "words binary") + ", ids binary, counts binary"


def _name_words(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The chunk with its words in the order of their ids; word 0 is the start."""
    answers = answers.sort_values("part")
    ids, counts = (np.concatenate([unsqueeze(x) for x in answers[k]]) for k in ("a", "b"))
    order = np.argsort(ids)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    return chunk.assign(tokens=squeeze(place[unsqueeze(chunk.tokens.iloc[0])]), ids=squeeze(np.diff(ids[order], prepend=0)), counts=squeeze(counts[order]))


def _part_of(first: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    return (spread(spread(first) + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Grams:
    """A chunk's distinct n-grams, a context and a word each, in the order in which it asks for them."""

    first: np.ndarray  # id of the context
    second: np.ndarray  # id of the word
    first_count: np.ndarray
    times: np.ndarray  # in the chunk's training texts
    low: np.ndarray  # count of the n-gram without its first word
    order: np.ndarray  # of the n-grams as they were given
    starts: np.ndarray  # of the parts
    salted: np.ndarray
    probes: list[np.ndarray]  # by part: contexts in several parts whose sums the chunk needs

    @classmethod
    def dealt(cls, first: np.ndarray, second: np.ndarray, first_count: np.ndarray, times: np.ndarray, low: np.ndarray, parts: int, total: int) -> Grams:
        """Of n-grams in the order of their ids."""
        # a context with more than a quarter of a part's share of tokens goes to several parts
        splits = np.maximum(1, -(-first_count * 4 * parts // max(1, total)))
        salted = splits > 1
        salt = np.zeros(len(first), np.int64)
        salt[salted] = spread(second[salted]) % splits[salted].astype(np.uint64)
        part = _part_of(first, salt, parts)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        probes: list[list[int]] = [[] for _ in range(parts)]
        many, at = np.unique(first[salted], return_index=True)
        for h, n in zip(many, splits[salted][at], strict=True):
            for p in np.unique(_part_of(np.full(n, h), np.arange(n), parts)):
                probes[p].append(int(h))
        starts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        return cls(first[order], second[order], first_count[order], times[order], low[order], order, starts, salted[order], [np.array(x, np.int64) for x in probes])

    def questions(self, chunk: int) -> pa.RecordBatch:
        made = []
        for p in range(len(self.probes)):
            a, b = self.starts[p], self.starts[p + 1]
            if a < b or len(self.probes[p]):
                first, runs = _runs(self.first[a:b])
                made.append((p, chunk, *(squeeze(v) for v in (np.diff(first, prepend=0), runs, self.second[a:b], self.times[a:b], self.low[a:b], self.probes[p]))))
        return _message_batch(made, [pa.int32(), pa.int64(), *[pa.binary()] * 6], QUESTION_NAMES)


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
    return first[begin], np.diff(np.append(begin, len(first)))


QUESTION_NAMES = ["part", "chunk", "first", "runs", "second", "times", "low", "probes"]
QUESTIONS = "part int, chunk long, " + ", ".join(f"{c} binary" for c in QUESTION_NAMES[2:])
STORED = ["first", "runs", "second", "times", "low"]
ANSWERS = "part int, chunk long, counts binary, ranks binary, gammas binary, " + ", ".join(f"{c} binary" for c in STORED) + ", " + ", ".join(f"{r} long" for r in RANKS)


def _answer(frame: pd.DataFrame, below: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """Count a part's n-grams over all chunks; tell each chunk its counts, and of contexts with
    an n-gram unseen in training the counts of counts and what ``below`` gives all seen."""
    release()
    frame = frame.sort_values("chunk")
    part, asked = int(frame.part.iloc[0]), [{c: unsqueeze(getattr(r, c)) for c in QUESTION_NAMES[2:]} for r in frame.itertuples()]
    whole = {c: np.concatenate([q[c] for q in asked]) for c in ("second", "times", "low", "runs", "probes")}
    firsts = np.concatenate([np.cumsum(q["first"]) for q in asked])
    heads, head = np.unique(np.concatenate([firsts, whole["probes"]]), return_inverse=True)
    head = np.repeat(head[: len(firsts)], whole["runs"])
    width = int(whole["second"].max(initial=0)) + 1
    if len(heads) * width < 1 << 62:
        order = np.argsort(head * width + whole["second"], kind="stable")  # merges the chunks' sorted runs
    else:
        order = np.lexsort((whole["second"], head))
    head, second = head[order], whole["second"][order]
    new = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])]) if len(head) else np.zeros(0, np.bool_)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    counts = np.add.reduceat(whole["times"][order], at) if len(at) else np.zeros(0, np.int64)
    head, second, low = head[at], second[at], whole["low"][order[at]]
    seen = counts > 0
    per_rank = np.stack([np.bincount(head[counts == r], minlength=len(heads)) for r in range(1, KEEP + 1)], axis=1) if len(heads) else np.zeros((0, KEEP), np.int64)
    gamma = np.bincount(head[seen], weights=below(low[seen]), minlength=len(heads))
    split = np.isin(heads, whole["probes"])
    kept_whole = ~split & (per_rank.sum(axis=1) == 0)
    signed = np.where(kept_whole[head], -counts, counts)
    nothing, out, at = [b""] * len(STORED) + [0] * len(RANKS), [], 0
    for chunk, q in zip(frame.chunk, asked, strict=True):
        mine = place[at : at + len(q["second"])]
        at += len(mine)
        if chunk >= 0:
            wanted = np.unique(head[mine[~seen[mine]]])
            wanted = np.concatenate([wanted[~split[wanted]], np.searchsorted(heads, q["probes"])])
            out.append([part, chunk, squeeze(signed[mine]), squeeze(per_rank[wanted].ravel().astype(np.int64)), squeeze(gamma[wanted]), *nothing])
    names, runs = _runs(heads[head[seen]])
    stored = (np.diff(names, prepend=0), runs, second[seen], counts[seen], low[seen])
    out.append([part, -1, squeeze(np.zeros(0, np.int64)), b"", b"", *(squeeze(x) for x in stored), *_ranks(counts)])
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])


def _resolved(x: Grams, answers: pd.DataFrame, discounts: Discounts, under: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """By n-gram as given: its count, negative where the context frees nothing, and the weight
    of the next lower order where the count is 0.

    ``under``: the count of the context without its first word, by which the masses seen
    after a context are to be divided; None if they are probabilities.
    """
    counts = np.zeros(len(x.first), np.int64)
    heads, ranks, gammas = [np.zeros(0, np.int64)], [], []
    for a in answers.itertuples():
        begin, end = x.starts[a.part], x.starts[a.part + 1]
        counts[begin:end] = got = unsqueeze(a.counts)
        open_, _ = _runs(x.first[begin:end][(got == 0) & ~x.salted[begin:end]])
        heads += [open_, x.probes[a.part]]
        ranks.append(unsqueeze(a.ranks).reshape(-1, KEEP))
        gammas.append(unsqueeze(a.gammas))
    known, place = np.unique(np.concatenate(heads), return_inverse=True)
    weights = np.ones(len(x.first))
    if len(known):
        per_rank = np.stack([np.bincount(place, weights=r, minlength=len(known)) for r in np.concatenate(ranks).T], axis=1)
        gamma = np.bincount(place, weights=np.concatenate(gammas), minlength=len(known))
        spot = np.minimum(np.searchsorted(known, x.first), len(known) - 1)
        told = known[spot] == x.first
        # contexts none of whose continuations is discounted set 1 / (count + 1) aside instead
        counts = np.where(told & x.salted & (per_rank.sum(axis=1) == 0)[spot], -np.abs(counts), counts)
        n = np.maximum(x.first_count, 1)
        freed = discounts.freed(per_rank)[spot] / n
        freed = np.where(freed > 0, freed, 1 / (n + 1))
        taken = gamma[spot] if under is None else Bigrams.share(gamma[spot], under[x.order])
        weights = np.where(told & (x.first_count > 0), freed / (1 - taken), 1.0)
    out = np.empty(len(counts), np.int64), np.empty(len(counts))
    out[0][x.order], out[1][x.order] = counts, weights
    return out


def _before(tokens: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """What precedes each token in its text; ``start`` before the first."""
    out = np.concatenate([[start], tokens[:-1]]).astype(np.int64)
    out[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = start
    return out


class Pairs:
    """A chunk's distinct pairs of words, in the order of their ids."""

    def __init__(self, row, texts: int) -> None:
        self.lengths = unsqueeze(row.lengths)
        self.training = np.repeat(unsqueeze(row.held) == 0, self.lengths)
        self.ids = np.concatenate([[START_ID], np.cumsum(unsqueeze(row.ids))])
        self.word_counts = np.concatenate([[texts], unsqueeze(row.counts)])
        self.tokens = unsqueeze(row.tokens).astype(np.int64)
        key, self.place = np.unique(_before(self.tokens, self.lengths, 0) * len(self.ids) + self.tokens, return_inverse=True)
        self.head, self.tail = key // len(self.ids), key % len(self.ids)

    def grams(self, parts: int, total: int) -> Grams:
        times = np.bincount(self.place, weights=self.training, minlength=len(self.head)).astype(np.int64)
        return Grams.dealt(self.ids[self.head], self.ids[self.tail], self.word_counts[self.head], times, self.word_counts[self.tail], parts, total)

    def probabilities(self, counts: np.ndarray, unseen: np.ndarray, discounts: Discounts) -> np.ndarray:
        p = Bigrams.share(Bigrams(discounts).mass(counts), self.word_counts[self.head])
        p[counts == 0] = unseen
        return p


STATE = NAMED + ", pair_counts binary, unseen binary"


def _state(chunk: pd.DataFrame, answers: pd.DataFrame, parts: int, total: int, texts: int, unigrams: Unigrams, discounts: Discounts) -> pd.DataFrame:
    """A chunk with the signed counts of its pairs and the probability of those unseen in training."""
    release()
    x = Pairs(chunk.iloc[0], texts)
    counts, weights = _resolved(x.grams(parts, total), answers, discounts, None)
    unseen = counts == 0
    return chunk.assign(pair_counts=squeeze(counts), unseen=squeeze(weights[unseen] * unigrams.probability(x.word_counts[x.tail[unseen]])))


class Triples:
    """A chunk's distinct trigrams whose first two words were seen in training, in the order of their ids.

    A pair's id as a context is made of both words' ids; above 2**31 words two such ids
    may meet, with a chance of about contexts / 2**64.
    """

    def __init__(self, pairs: Pairs, pair_counts: np.ndarray, texts: int) -> None:
        before = _before(pairs.place + 1, pairs.lengths, 0)
        known = np.concatenate([[texts], np.abs(pair_counts)])  # the count of a pair as a context
        self.at = np.flatnonzero(known[before] > 0)  # the tokens after such a pair
        key, first, self.place = np.unique(before[self.at] * len(pairs.ids) + pairs.tokens[self.at], return_index=True, return_inverse=True)
        context = key // len(pairs.ids)
        self.pair = pairs.place[self.at[first]]  # of the last two words
        self.count = known[context]
        self.under = pairs.word_counts[pairs.head[self.pair]]
        self.contexts = np.concatenate([[START_ID], (pairs.ids[pairs.head] << 32) + pairs.ids[pairs.tail]])[context]
        self.words = pairs.ids[key % len(pairs.ids)]
        self.times = np.bincount(self.place, weights=pairs.training[self.at], minlength=len(key)).astype(np.int64)
        self.low = pair_counts[self.pair]

    def grams(self, parts: int, total: int) -> Grams:
        return Grams.dealt(self.contexts, self.words, self.count, self.times, self.low, parts, total)


def _scores(chunk: pd.DataFrame, answers: pd.DataFrame, parts: int, total: int, texts: int, unigrams: Unigrams, pairs: Discounts, triples: Discounts) -> pd.DataFrame:
    release()
    row = chunk.iloc[0]
    x, pair_counts = Pairs(row, texts), unsqueeze(row.pair_counts)
    below = x.probabilities(pair_counts, unsqueeze(row.unseen), pairs)
    y = Triples(x, pair_counts, texts)
    counts, weights = _resolved(y.grams(parts, total), answers, triples, y.under)
    p = np.where(counts != 0, Bigrams.share(Bigrams(triples).mass(counts), y.count), weights * below[y.pair])
    logs = np.log10(below)[x.place]  # an unknown context leaves all to the pair
    logs[y.at] = np.log10(p)[y.place]
    doc = np.repeat(np.arange(len(x.lengths)), x.lengths)
    word_counts = x.word_counts[x.tokens]
    base = np.log10((word_counts + 1) / (unigrams.total + unigrams.types + 1))
    sums = lambda v: np.bincount(doc, weights=v, minlength=len(x.lengths))
    ids = pd.array(unsqueeze(row.docs), "Int64")
    ids[unsqueeze(row.nulls) == 1] = pd.NA
    return pd.DataFrame({
        "doc_id": ids, "held_out": unsqueeze(row.held) == 1, "n_tokens": x.lengths, "n_known": sums(word_counts > 0).astype(np.int64),
        "train_tokens": unigrams.total, "base_score": sums(base), "score": sums(logs),
    })


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TABLES = ("unigrams", "bigrams", "trigrams")


@dataclass(frozen=True)
class Model:
    """Counts in three tables of parts, and what holds for all of them."""

    unigrams: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame
    parts: int
    tokens: int
    texts: int

    def write(self, path: str) -> None:
        """One row a part in each table; a part's row answers for all n-grams dealt to it."""
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.unigrams.sparkSession.createDataFrame([(self.parts, self.tokens, self.texts)], "parts long, tokens long, texts long").write.parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        parts, tokens, texts = spark.read.parquet(f"{path}/totals").collect()[0]
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in TABLES), parts, tokens, texts)


def _evaluated(docs: DataFrame, learn_from: Callable, key: str, text: str, model: Model | None) -> tuple[DataFrame, Model]:
    """Scores of all rows, under ``model`` or the one learned from the rows not held out."""
    spark = docs.sparkSession
    ship_package(spark)
    space = Workspace(spark, "katz")
    chosen = docs.select(docs[key].cast("long").alias("doc_id"), learn_from(docs[key]).alias("held_out"), docs[text].cast("string").alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunk_bytes = TOKEN_BYTES * share_tokens(size // TOKEN_BYTES)
    chunks = space.write(chosen.mapInArrow(lambda b: _encoded(b, chunk_bytes), CHUNKS), "chunks")
    if model:
        parts, tokens, texts = model.parts, model.tokens, model.texts
    else:
        tokens, texts = (x or 0 for x in chunks.agg(F.sum("n_tokens"), F.sum("n_texts")).collect()[0])
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // share_tokens(tokens)))
    stored = lambda name, columns: [getattr(model, name).select(*columns)] if model else []

    def told(asked: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, name: str, columns: list[str]) -> DataFrame:
        for more in stored(name, columns):
            asked = asked.unionByName(more)
        return space.write(asked.groupBy("part").applyInPandas(answer, schema), name)

    def counts_of(answers: DataFrame, *columns: str) -> list[int]:
        return list(answers.filter("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).collect()[0])

    def kept(answers: DataFrame, name: str, *columns) -> DataFrame:
        return space.write(answers.filter("chunk = -1").select("part", "chunk", *columns), f"model_{name}")

    asked = chunks.mapInArrow(lambda b: _ask_words(b, parts), WORD_QUESTIONS)
    answers = told(asked, lambda p: _answer_words(p, parts), WORD_ANSWERS, "unigrams", ["part", "chunk", "words", "counts"])
    types, total, *ranks = counts_of(answers, "types", "total", *RANKS)
    discounts = Discounts.of(ranks)
    # all discounted counts together: the total less what counts up to KEEP give away
    unigrams = Unigrams(discounts, total, types, total - float(discounts.freed(np.array([ranks[:KEEP]]))[0]))
    replies = answers.filter("chunk >= 0").select("chunk", "part", "a", "b")
    named = space.write(chunks.drop("words").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_name_words, NAMED), "named")
    one = model.unigrams if model else kept(answers, "unigrams", F.col("a").alias("words"), F.col("b").alias("counts"))
    space.drop("chunks", "unigrams")

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Pairs(row, texts).grams(parts, tokens).questions(row.chunk)

    def of_chunks(answers: DataFrame):
        return answers.filter("chunk >= 0").select("chunk", "part", "counts", "ranks", "gammas").groupBy("chunk")

    stored_grams = [*STORED, F.col("counts").alias("probes")]
    answers = told(named.mapInArrow(ask_pairs, QUESTIONS), lambda p: _answer(p, unigrams.probability), ANSWERS, "bigrams", QUESTION_NAMES)
    two = Discounts.of(counts_of(answers, *RANKS))
    state = named.groupBy("chunk").cogroup(of_chunks(answers)).applyInPandas(lambda a, b: _state(a, b, parts, tokens, texts, unigrams, two), STATE)
    state = space.write(state, "state")
    pairs = model.bigrams if model else kept(answers, "bigrams", *stored_grams)
    space.drop("named", "bigrams")

    def ask_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Triples(Pairs(row, texts), unsqueeze(row.pair_counts), texts).grams(parts, tokens).questions(row.chunk)

    answers = told(state.mapInArrow(ask_triples, QUESTIONS), lambda p: _answer(p, Bigrams(two).mass), ANSWERS, "trigrams", QUESTION_NAMES)
    three = Discounts.of(counts_of(answers, *RANKS))
    scores = state.groupBy("chunk").cogroup(of_chunks(answers)).applyInPandas(lambda a, b: _scores(a, b, parts, tokens, texts, unigrams, two, three), RESULT)
    triples = model.trigrams if model else answers.filter("chunk = -1").select("part", "chunk", *stored_grams)
    return scores, Model(one, pairs, triples, parts, tokens, texts)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of all rows of ``docs``."""
    return _evaluated(docs, lambda k: F.lit(False), key, text, None)[1]


def scored_by(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``katz_scores``, under a stored model; every row is held out."""
    return _evaluated(docs, lambda k: F.lit(True), key, text, model)[0]


def katz_scores(docs: DataFrame, folds: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, the add-one unigram score, and the log10
    probability of the text under the trigram model learned from the rows not held out.

    Tokens: words with A-Z lowered, then one end; the first word follows two starts that
    are counted but not scored.  P(w | h) = d c(h, w) / c(h) if seen, else the mass
    freed in h, times P(w | h without its first word), over what the words unseen after h
    have of that; the same holds there.  A context that frees nothing sets 1 / (c(h) + 1)
    aside; an unknown context falls back whole.  P(w) is discounted likewise and gives
    the rest to one unknown word.

    A null or empty text is its end alone.  Repeated rows count as often as they
    occur.  Other columns are ignored; an empty table gives an empty result.
    """
    return _evaluated(docs, lambda k: remainder(k, folds) == held, key, text, None)[0]
