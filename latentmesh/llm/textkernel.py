"""Vectorised word and shingle hashing over Arrow string arrays.

Every function works on whole texts.  A word is a maximal run of ASCII letters,
ASCII digits and non-ASCII characters of the lower-cased text; everything else
separates words, so punctuation and case do not change a hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are worked on in blocks of so many bytes, which end between words, so that the arrays of a block fit in a core's cache.
_BLOCK_BYTES = 1 << 18

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD_BYTE[_lo:_hi] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _BLOCK_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = (tables[0], tables[1])
    return _powers


def release() -> None:
    """Gives back the memory of arrays that are gone, where the C library doesn't by itself."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which outlives the task, gives back the memory that its arrays took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = _BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` elements each; a longer row has a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _cuts(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about ``size`` that end where no word does go on; a longer word has a range of its own."""
    n, lo, step = len(buf), 0, min(size, 4096)
    while lo < n:
        hi = lo + size
        if hi < n:
            at = int(off[np.searchsorted(off, hi, side="right") - 1])
            for back in (step, size):  # a gap is near, as a rule
                gaps = np.flatnonzero(~_WORD_BYTE[buf[hi - back : hi]])
                if len(gaps):
                    at = max(at, hi - back + int(gaps[-1]) + 1)
                    break
            while at <= lo:
                row = int(off[np.searchsorted(off, hi, side="left")])
                gaps = np.flatnonzero(~_WORD_BYTE[buf[hi : min(row, hi + size)]])
                at = hi + int(gaps[0]) + 1 if len(gaps) else row if row <= hi + size else lo
                hi += size
            hi = at
        yield lo, min(n, hi)
        lo = hi


def _block_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _WORD_BYTE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    start[cuts] = inside[cuts]
    starts = np.flatnonzero(start)
    end = ~inside
    end[0] = False
    end[1:] &= inside[:-1]
    cuts = cuts[cuts > 0]
    end[cuts] |= inside[cuts - 1]
    ends = np.flatnonzero(end)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    value = buf.astype(np.uint64)
    value += np.uint64(1)
    value *= power[:n]
    np.cumsum(value, out=total[1:])
    h = mix64((total[ends] - total[starts]) * inverse[starts])
    return h, starts, ends


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and the row offsets into them."""
    buf, off = utf8(texts)
    out, counts = [], np.zeros(len(off) - 1, dtype=np.int64)
    for lo, hi in _cuts(buf, off, _BLOCK_BYTES):
        first, last = int(np.searchsorted(off, lo, side="right")) - 1, int(np.searchsorted(off, hi, side="left"))
        local = np.clip(off[first : last + 1] - lo, 0, hi - lo)
        h, starts, _ = _block_words(buf[lo:hi], local)
        counts[first:last] += np.diff(np.searchsorted(starts, local))
        out.append(h)
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` in a row, whatever rows they lie in."""
    many = max(0, len(h) - n + 1)
    total = np.zeros(many, dtype=np.uint64)
    for k in range(n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += h[k : k + many]
    return mix64(total)


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside one row, their row offsets and word positions.

    A row of fewer than ``n`` words has none.
    """
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out, np.zeros(0, np.int64)
    position = np.arange(out[-1], dtype=np.int64) - np.repeat(out[:-1], counts)
    return runs(h, n)[position + np.repeat(offsets[:-1], counts)], out, position
