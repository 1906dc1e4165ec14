"""Elias-Fano coded non-decreasing sequences and bytes for small counts, in numpy."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A non-decreasing sequence of n unsigned integers up to ``top`` in about 2 + log2(top / n) bits each.

    The low bits of every value lie packed one after the other; the high parts are a bit vector with a one
    for each value and a zero for each step of the high part. ``data`` holds both and can be a view of a
    memory-mapped file or of a received buffer; it is copied nowhere."""

    def __init__(self, n: int, top: int, data: np.ndarray):
        self.n, self.top = n, top
        self.bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        packed = (n * self.bits + 7) // 8
        self._low, self._high = data[:packed + 8], data[packed + 8:]
        self._starts: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        out = cls(len(values), top, np.zeros(0, np.uint8))
        bits, n = out.bits, len(values)
        packed = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            byte, shift = at >> 3, (at & 7).astype(np.uint64)
            low = low << shift  # at most 56 + 7 bits: one 64-bit word holds it
            for k in range((bits + 7 + 7) // 8):
                # values of neighbours share bytes, so bytes are united and not stored
                part = ((low >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
                np.bitwise_or.at(packed, byte + k, part)
        high = (values >> np.uint64(bits)).astype(np.int64)
        ones = np.zeros(n + (top >> bits) + 1, bool)
        ones[high + np.arange(n)] = True
        return cls(n, top, np.concatenate([packed, np.packbits(ones, bitorder="little")]))

    @property
    def data(self) -> np.ndarray:
        return np.concatenate([self._low, self._high])

    def _ones(self) -> np.ndarray:
        return np.unpackbits(self._high, bitorder="little", count=self.n + (self.top >> self.bits) + 1)

    def starts(self) -> np.ndarray:
        """For each high part the index of its first value, one entry more than high parts."""
        if self._starts is None:
            zeros = np.flatnonzero(self._ones() == 0)
            self._starts = np.concatenate([[0], zeros - np.arange(len(zeros))])
        return self._starts

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        words = np.ndarray((len(self._low) - 7,), "<u8", self._low, strides=(1,))
        return (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def values(self) -> np.ndarray:
        high = (np.flatnonzero(self._ones()) - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.low(np.arange(self.n))

    def successor(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each q the first index within [lo, hi) whose value is at least q (hi if there is none)."""
        q = np.ascontiguousarray(q, np.uint64)
        part = np.minimum(q >> np.uint64(self.bits), np.uint64(self.top >> self.bits)).astype(np.int64)
        starts = self.starts()
        a, b = np.maximum(starts[part], lo), np.minimum(starts[part + 1], hi)
        want = q & np.uint64((1 << self.bits) - 1)
        over = (q >> np.uint64(self.bits)) > np.uint64(self.top >> self.bits)
        a = np.where(over, hi, np.minimum(a, hi))
        b = np.maximum(a, b)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.low(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in full."""
    x = np.asarray(x, np.int64)
    large = x >= 255
    return np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = x == 255
    x[large] = np.frombuffer(data, "<i8", offset=n)
    return x
