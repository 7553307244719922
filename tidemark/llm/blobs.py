"""Compressed numpy arrays in binary columns."""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    if x.dtype.kind not in "iu" or not len(x):
        return x
    low, high = int(x.min()), int(x.max())
    for kind in ("u1", "u2", "u4") if low >= 0 else ("i1", "i2", "i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind) if np.dtype(kind).itemsize < x.dtype.itemsize else x
    return x


def squeeze(x: np.ndarray) -> bytes:
    """Type and values in the smallest type, byte planes apart."""
    small = np.ascontiguousarray(_narrow(x))
    size = small.dtype.itemsize
    planes = small.view(np.uint8).reshape(-1, size)
    return x.dtype.str.encode() + small.dtype.str.encode() + _packer().compress(b"".join(planes[:, k].tobytes() for k in range(size)) if size > 1 else small.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    kind, small = np.dtype(blob[:3].decode()), np.dtype(blob[3:6].decode())
    flat = np.frombuffer(_unpacker().decompress(blob[6:]), np.uint8)
    if small.itemsize == 1:
        return flat.view(small).astype(kind)
    planes = flat.reshape(small.itemsize, -1)
    out = np.empty((planes.shape[1], small.itemsize), np.uint8)
    for k in range(small.itemsize):
        out[:, k] = planes[k]
    return out.view(small).ravel().astype(kind, copy=False)


def release() -> None:
    """Give freed memory back, so that idle workers do not keep the peak of their last task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
