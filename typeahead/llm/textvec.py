"""Whole Arrow batches of text as numpy byte arrays: words, spans, 64-bit hashes.

A batch is one byte array plus document offsets. Words are runs of bytes
outside space and 0x09-0x0D, which in UTF-8 equals ``[^\\x20\\x09-\\x0D]+``.
Span hashes are differences of one running polynomial sum modulo 2**64 with
random byte values, so that hashing costs a few array passes and no loop.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

pa.set_memory_pool(pa.system_memory_pool())  # what it frees, ``give_back`` can return

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240601)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Text bytes that the operators work on at once.
CHUNK = 1 << 20
#: Length of the power tables; sums over longer arrays go on in blocks of it.
SPAN = 1 << 16


@lru_cache
def _table(base: int) -> np.ndarray:
    p = np.full(SPAN, U64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


def _steps(base: int, n: int) -> np.ndarray:
    """base**(SPAN * i) modulo 2**64 for i < n."""
    p = np.full(max(n, 1), U64(pow(base, SPAN, 1 << 64)))
    p[0] = 1
    return np.multiply.accumulate(p)


def running(items: np.ndarray, base: int, value: np.ndarray | None = None) -> np.ndarray:
    """Running sums of items[i] * base**i (of value[items[i]] if given), with a zero in front.

    The powers come from two short tables, so that no table grows with the longest text seen.
    """
    n, low = len(items), _table(base)
    high = _steps(base, -(-n // SPAN))
    out = np.empty(n + 1, U64)
    out[0] = 0
    for k, a in enumerate(range(0, n, SPAN)):
        part = items[a : a + SPAN] if value is None else value[items[a : a + SPAN]]
        block = out[a + 1 : a + 1 + len(part)]
        np.cumsum(part * low[: len(part)], out=block)
        block *= high[k]
        block += out[a]
    return out


def shifted(x: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """x * base**-at: differences of running sums, freed of their place."""
    inverse = pow(base, -1, 1 << 64)
    high = _steps(inverse, (int(at.max()) // SPAN + 1) if len(at) else 1)
    return x * _table(inverse)[at & (SPAN - 1)] * high[at // SPAN]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` text bytes, at least one row each.

    A text is never cut: one longer than ``limit`` is a slice of its own, and the
    arrays over it take some 40 bytes for each of its bytes while it is worked on.
    """
    n = batch.num_rows
    if not n:
        return
    off = column_bytes(batch.column(column))[1]
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system, as a worker outlives its task and serves later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and the first word of each document (n + 1 long)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    cut = edge[1:n]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut
    end = solid
    end = end.copy()
    end[:-1] &= ~solid[1:] | cut
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    run = running(data, BASE, BYTE_VALUE)
    return mix(shifted(run[e] - run[s], s, BASE) + (e - s).astype(U64) * U64(0xA24BAED4963EE407))


def gram_sums(h: np.ndarray) -> np.ndarray:
    """Running sums from which ``grams`` takes the hash of any run of items."""
    return running(h, WORD_BASE)


def grams(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of items start..end-1, equal for equal sequences wherever they stand."""
    return mix(shifted(run[end] - run[start], start, WORD_BASE) + (end - start).astype(U64))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of the next, and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)


def first_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The first place of each code."""
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out
