"""Elias-Fano coding of a non-decreasing integer sequence, with select.

The low bits of each value are packed plainly; the high parts are a bit vector with a one for each
value, in unary steps. A sampled directory holds the place of every 256th one, so
``select`` reads a bounded stretch of the vector. n values up to u take about n * (2 + log2(u / n)) bits.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
HEAD = struct.Struct("<QQBQ")


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, from 0 up."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = (v >> np.uint64(low)).astype(np.int64)
    ones = high + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::STEP].astype("<u4" if n == 0 or ones[-1] < 2**32 else "<u8")
    return HEAD.pack(n, len(packed), low | (0 if samples.itemsize == 4 else 128), len(samples)) + samples.tobytes() + packed + np.packbits(bits.ravel(), bitorder="little").tobytes()


class EliasFano:
    def __init__(self, raw: bytes, at: int = 0):
        self.n, size, low, count = HEAD.unpack_from(raw, at)
        self.low = low & 127
        kind = "<u8" if low & 128 else "<u4"
        at += HEAD.size
        self.samples = np.frombuffer(raw, kind, count, at)
        at += self.samples.nbytes
        self.upper = np.frombuffer(raw, np.uint8, size, at)
        at += size
        self.lower = np.frombuffer(raw, np.uint8, (self.n * self.low + 7) // 8, at)
        self.end = at + len(self.lower)

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low or not count:
            return np.zeros(count, np.uint64)
        a, z = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lower[a // 8 : (z + 7) // 8], bitorder="little")[a % 8 : a % 8 + z - a]
        return (bits.reshape(count, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the directory and one stretch of the vector."""
        k = i // STEP
        a = int(self.samples[k])
        z = int(self.samples[k + 1]) + 1 if k + 1 < len(self.samples) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[a // 8 : (z + 7) // 8], bitorder="little")
        bits[: a % 8] = 0
        one = a // 8 * 8 + int(np.flatnonzero(bits)[i % STEP])
        return ((one - i) << self.low) | int(self._lows(i, 1)[0])

    def all(self) -> np.ndarray:
        """All values: select for every place in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._lows(0, self.n)
