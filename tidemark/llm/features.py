"""Hashed word features and structure statistics of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, np.bool_)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(chars)] = True
    return table


# The byte classes whose shares are structure statistics.
CLASSES = tuple(_marks(c) for c in (b"#*$%&|<>@^~=", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?\"'()-", b"\n", bytes(range(128, 256))))
STATS = len(CLASSES) + 6


@dataclass
class Rows:
    """Sparse rows: row i has ids[starts[i]:starts[i + 1]] with their counts, and dense[i]."""

    starts: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    dense: np.ndarray


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts of about SLICE_BYTES; null is empty."""
    raw = column.cast(pa.large_binary())
    raw = raw.fill_null(b"") if raw.null_count else raw
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, np.bool_)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _mixed(x: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x51ED27 + 1)) * MIX
    x ^= x >> np.uint64(29)
    x *= MIX2
    return (x >> np.uint64(64 - buckets)).astype(np.int64)


def _word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, from a running sum over all bytes."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(low) + 1, MIX, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        # the sum over a word times the power that brings its last byte to a fixed place
        inverse = np.uint64(pow(int(MIX), -1, 2**64))
        back = np.cumprod(np.full(len(low) + 1, inverse, np.uint64))
        return (sums[end] - sums[begin]) * back[begin]


def sparse_rows(data: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...] = ()) -> Rows:
    """Counts of hashed lower-case words, and of word prefixes of so many bytes, in 2**bits buckets."""
    docs, low = len(offsets) - 1, _LOWER[data]
    begin, end = _word_bounds(data, offsets)
    of = np.searchsorted(offsets, begin, "right") - 1
    length = end - begin
    made = [(of << bits) + _mixed(_word_hashes(low, begin, end), 0, bits)] if len(begin) else []
    if prefixes and len(begin):
        padded = np.concatenate([low, np.zeros(8, np.uint8)]).astype(np.uint64)
        value = np.zeros(len(begin), np.uint64)
        for k in range(max(prefixes)):
            value |= padded[begin + k] << np.uint64(8 * k)
            if k + 1 in prefixes:
                long = length > k
                made.append((of[long] << bits) + _mixed(value[long], k + 1, bits))
    keys, counts = np.unique(np.concatenate(made), return_counts=True) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = keys >> bits
    starts = np.searchsorted(row, np.arange(docs + 1))
    return Rows(starts, (keys & ((1 << bits) - 1)).astype(np.int32), counts.astype(np.float32), _structure(data, offsets, begin, of, length, starts))


def _structure(data, offsets, begin, of, length, starts) -> np.ndarray:
    docs, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(np.float64)
    words = np.bincount(of, minlength=docs) if len(of) else np.zeros(docs)
    chars = np.bincount(of, weights=length, minlength=docs) if len(of) else np.zeros(docs)
    some = np.maximum(words, 1)
    out = [np.log1p(words), np.log1p(size), chars / some, np.diff(starts) / some, words < 10]
    squares = np.bincount(of, weights=length.astype(np.float64) ** 2, minlength=docs) if len(of) else np.zeros(docs)
    out.append(np.sqrt(np.maximum(squares / some - (chars / some) ** 2, 0)))
    for table in CLASSES:
        total = np.concatenate([[0], np.cumsum(table[data])])
        out.append(np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / size))
    return np.stack([np.asarray(x, np.float64) for x in out], axis=1)


def joined(parts: list[Rows]) -> Rows:
    starts, at = [np.zeros(1, np.int64)], 0
    for p in parts:
        starts.append(p.starts[1:] + at)
        at += len(p.ids)
    return Rows(np.concatenate(starts), *(np.concatenate([getattr(p, n) for p in parts]) if parts else np.zeros((0, STATS) if n == "dense" else 0, np.float32) for n in ("ids", "counts", "dense")))


def row_numbers(rows: Rows) -> np.ndarray:
    return np.repeat(np.arange(len(rows.starts) - 1), np.diff(rows.starts))
