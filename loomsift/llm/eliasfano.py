"""Elias-Fano code of a non-decreasing sequence, with select.

Each value is split: ``l`` low bits are packed side by side, the high part is written
in unary (value ``i`` sets bit ``high + i``).  That takes about ``2 + log2(u / n)`` bits
a value.  A sample of every ``STEP``-th set bit makes select a short scan of one word
range; nothing is expanded into a table of offsets.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 512
_HEAD = struct.Struct("<qqiiqq")


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    planes = (values[:, None] >> np.arange(bits, dtype=np.int64)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def pack(values: np.ndarray) -> bytes:
    """The code of non-decreasing 64-bit integers."""
    v = np.asarray(values, np.int64)
    if len(v) and (np.diff(v) < 0).any():
        raise ValueError("values must not decrease")
    base = int(v[0]) if len(v) else 0
    v = v - base
    span = int(v[-1]) + 1 if len(v) else 0
    bits = max(0, (span // len(v)).bit_length() - 1) if len(v) else 0
    low = b"".join(_pack_low(v[i:i + 65536] & ((1 << bits) - 1), bits) for i in range(0, len(v), 65536))
    at = (v >> bits) + np.arange(len(v))
    size = int(at[-1]) + 1 if len(v) else 0
    high = np.zeros((size + 7) // 8, np.uint8)
    np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
    samples = at[::STEP].astype("<i8").tobytes()
    return _HEAD.pack(len(v), base, bits, STEP, len(low), len(high)) + samples + low + high.tobytes()


class EliasFano:
    """Reads a packed sequence in place."""

    def __init__(self, data: bytes | memoryview, offset: int = 0):
        self.n, self.base, self.bits, self.step, low, high = _HEAD.unpack_from(data, offset)
        at = offset + _HEAD.size
        count = -(-self.n // self.step)
        self.samples = np.frombuffer(data, "<i8", count, at)
        at += 8 * count
        self.low = np.frombuffer(data, np.uint8, low, at)
        at += low
        self.high = np.frombuffer(data, np.uint8, high, at)
        self.end = at + high

    def _low(self, i: int) -> int:
        # Values are packed in whole groups of 65,536, which end on a byte.
        first = i * self.bits
        last = first + self.bits
        if not self.bits:
            return 0
        group = int.from_bytes(self.low[first >> 3:(last + 7) >> 3].tobytes(), "little")
        return (group >> (first & 7)) & ((1 << self.bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // self.step])
        left = i % self.step
        byte = start >> 3
        word = int(self.high[byte]) & (0xFF << (start & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = (byte << 3) + (word & -word).bit_length() - 1
        return self.base + (((at - i) << self.bits) | self._low(i))

    def blocks(self, size: int = 65536):
        """All values, block by block."""
        for first in range(0, self.n, size):
            n = min(size, self.n - first)
            i = np.arange(first, first + n)
            lo = int(self.samples[first // self.step]) if first % self.step == 0 else 0
            hi = (int(self.samples[(first + n) // self.step]) if first + n < self.n and (first + n) % self.step == 0
                  else 8 * len(self.high))
            ones = np.flatnonzero(np.unpackbits(self.high[lo >> 3:(hi + 7) >> 3], bitorder="little")) + (lo & ~7)
            at = ones[np.searchsorted(ones, lo):][:n] if first % self.step == 0 else ones[first:first + n]
            low = np.zeros(n, np.int64)
            if self.bits:
                a, b = first * self.bits, (first + n) * self.bits
                planes = np.unpackbits(self.low[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a]
                low = planes.reshape(n, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
            yield self.base + (((at - i) << self.bits) | low)

    def values(self) -> np.ndarray:
        parts = list(self.blocks())
        return np.concatenate(parts) if parts else np.empty(0, np.int64)
