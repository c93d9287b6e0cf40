"""Byte-level text primitives shared by the operators: whole Arrow batches at a time, in numpy.

A *word* is a maximal run of bytes other than ASCII white space (9-13 and 32). Every function
takes the concatenated UTF-8 bytes of some rows and the row offsets, so that a batch of any mix of
short and long texts costs a fixed number of vector operations. Null texts arrive as empty ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table asked for so far is kept up to 32 MB."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
        if len(have) <= 4 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes.

    A row longer than the limit is a run of its own: no text is ever cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    if len(data) >= SLICE_BYTES:
        release()


try:
    _trim = ctypes.CDLL(None).malloc_trim  # of glibc
except (AttributeError, OSError):
    _trim = None


def release() -> None:
    """Gives free memory back to the system: a worker lives on between jobs, and allocators keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row boundary the number of words before it."""
    solid = ~WHITE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(data) + 1, np.uint64)
        x = data.astype(np.uint64)
        x += np.uint64(1)
        x *= _power(_BASE, len(data))
        np.cumsum(x, out=h[1:])
    return h


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        inverse = _power(_INVERSE, len(prefix))
        return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of ``word`` (len(word) - k + 1 of them)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += word[j : j + n]
    return mix(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
