"""Vectorised text kernels for the Python-side operators: words of whole texts
as 64-bit hashes, computed over Arrow buffers without a Python loop per word.

Equal words have equal hashes; different words share one with probability of
about 2**-64 (a tabulated polynomial hash, mixed with the word's length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18          # bytes hashed at once: bounds memory for very long texts
SLICE = 2 << 20          # bytes of text in one run of rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_POWERS: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in text whose A-Z are lowered
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for base in (_BASE, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's start in them (a null row is empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start and end. No word crosses rows."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[LOWER[raw]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each row's first word
    (one more entry than rows). A-Z are lowered."""
    starts, ends = spans(raw, offsets, table)
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = LOWER[raw]
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_VALUE[low[a:b]] * up[:b - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        lo = hi
    return out


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles. A row with
    fewer words has its whole sequence as one; a row without words has none."""
    factor = mix((np.arange(k, dtype=np.uint64) + np.uint64(7)) * _STEP) | np.uint64(1)
    n = len(h)
    if n >= k:
        all_k = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            all_k += h[j:n - k + 1 + j] * factor[j]
        all_k = mix(all_k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(all_k[a:b - k + 1]))
        elif b > a:
            whole = (h[a:b] * factor[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
