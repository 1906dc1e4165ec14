"""Numpy views of Arrow text: blocks of whole texts, word spans and word hashes.

A word is a run of bytes outside ``\\x20\\x09-\\x0D`` (``WORD`` in the docstrings). All helpers
work on the UTF-8 buffer of a block, so nothing is done per row in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per block; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20011).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task; afterwards the worker process, which serves further tasks and
    queries, gives back the memory that it no longer uses."""
    @wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
        if trim is not None:
            trim(0)

    return whole


class Block:
    """Rows ``lo:hi`` of a batch with their UTF-8 bytes and byte offsets."""

    def __init__(self, lo: int, hi: int, raw: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.raw, self.offsets = lo, hi, raw, offsets

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts with at most ``limit`` bytes (one text at least). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[raw]


def lowered_latin(raw: np.ndarray) -> np.ndarray:
    """As ``lowered``, with the two-byte capitals of Latin-1 too."""
    out = _LOWER[raw]
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][capital] += 32
    return out


class Words:
    """Word spans of a block: byte ``start`` and ``end``, and ``first``: for each row the index of
    its first word (one entry more than rows). ``solid`` marks the bytes of words, by default all
    but white space."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None):
        if solid is None:
            solid = ~_SPACE[raw]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        begin[cuts] |= solid[cuts]
        stop[cuts - 1] |= solid[cuts - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class SpanHash:
    """64-bit hashes of any byte spans of a buffer, from one prefix sum of its bytes."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw] * powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(raw) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (empty if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_INVERSE, len(h) + 1)[:len(h) - n + 1])


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.int64).view(np.uint64)
