"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import hashes, ngram_hashes, raw_texts, rolled
from .workspace import ship_package

# The largest share of characters that may lie in the most frequent n-gram, by n.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
# The largest share of characters that may lie in n-grams found twice or more, by n.
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

SYMBOLS = np.zeros(256, np.bool_)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACES = np.zeros(256, np.bool_)
SPACES[list(b" \t\n\r\x0b\x0c")] = True


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``length`` words lie in the n-word windows at these starts."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_starts(grams: np.ndarray) -> np.ndarray:
    """Positions whose n-gram occurs at least twice, the first included."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return order[:0]
    twice = np.zeros(len(grams), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def measure(raw: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst share."""
    data = np.frombuffer(raw, np.uint8)
    words = raw.split()
    n = len(words)
    whole = (data & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(whole)) - int(np.count_nonzero(SPACES[data]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    single = hashes(words)
    grams = ngram_hashes(single, WINDOW) if n >= WINDOW else single[:0]
    starts = repeated_starts(grams)
    inside = covered(starts, WINDOW, n) if len(starts) else None
    n_repeat = int(inside.sum()) if inside is not None else 0
    base_failed = n < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n
    verdict, worst = True, 0.0
    if not base_failed:
        worst = excess(raw, words, single, starts, inside, lines, n_dup_lines, word_chars)
        verdict = worst <= 1.0
    return n, word_chars, int(np.count_nonzero(SYMBOLS[data])), n_dup_lines, n_repeat, base_failed, bool(not base_failed and verdict), worst


def excess(raw, words, single, starts, inside, lines, n_dup_lines, word_chars) -> float:
    """The largest of all shares over their limits; up to 1 passes.

    Shares are of the characters in words.  The most frequent n-gram counts each of
    its occurrences whole only if it occurs twice or more; of equally frequent ones
    the longest counts.
    """
    sizes = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    worst = 0.0
    if n_dup_lines:
        seen, chars = set(), 0
        for line in lines:
            if line in seen:
                chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
        worst = chars / word_chars / LINE_LIMIT
    grams = single
    for k, limit in TOP_LIMITS.items():
        if len(words) < k:
            break
        grams = rolled(grams, single, k)
        values, first, counts = np.unique(grams, return_index=True, return_counts=True)
        most = counts.max()
        if most >= 2:
            at = first[counts == most]
            worst = max(worst, float(most * (ends[at + k] - ends[at]).max()) / word_chars / limit)
    for k, limit in DUPLICATE_LIMITS.items():
        if not len(starts):
            break
        if k > WINDOW:
            grams = rolled(grams, single, k)
            starts = repeated_starts(grams)
            inside = covered(starts, k, len(words)) if len(starts) else np.zeros(len(words), np.bool_)
        else:
            grams = rolled(grams, single, k)
        worst = max(worst, float(sizes[inside].sum()) / word_chars / limit)
    return worst


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("worst_share", pa.float64())]
)


def repetition_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the base counts, the base rule and the method's verdict.

    A null or empty text has no words and fails.  Texts are read whole, whatever
    their length; repeated rows are measured alike; other columns are ignored; an
    empty table gives an empty result.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x) for x in raw_texts(batch.column("text"))]
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(SCHEMA)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=SCHEMA)

    chosen = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, worst_share double")
