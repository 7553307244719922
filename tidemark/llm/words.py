"""Words, hashes and rolling n-gram hashes of UTF-8 texts, in numpy.

Words are runs of anything but the bytes 0x20 and 0x09-0x0D; on UTF-8 bytes that is
what ``bytes.split()`` yields, whatever the script.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolled(previous: np.ndarray, single: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams from those of the (n-1)-grams, mod 2**64."""
    return previous[: len(single) - n + 1] * BASE + single[n - 1 :]


def ngram_hashes(single: np.ndarray, n: int) -> np.ndarray:
    grams = single
    for k in range(2, n + 1):
        grams = rolled(grams, single, k)
    return grams
