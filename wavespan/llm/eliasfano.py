"""Elias-Fano code of a non-decreasing sequence: about 2 + log2(u / n) bits a value.

The low ``width`` bits of each value are packed side by side. The high bits are unary: value i
sets bit ``(value >> width) + i``, so the position of the i-th set bit gives them back. Every
``EVERY``-th position is kept, which lets ``select`` start near the wanted bit.
"""

from __future__ import annotations

import dataclasses

import numpy as np

EVERY = 256
#: Bytes of high bits that select looks at in one go.
STEP = 256
ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


@dataclasses.dataclass(frozen=True)
class EliasFano:
    n: int
    width: int
    lower: bytes
    upper: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` ascending in [0, universe]; any may repeat."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (max(universe, 1) // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(width)) & 1
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        high[at] = 1
        return cls(n, width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(),
                   at[::EVERY].astype("<u8").tobytes())

    def low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        word = int.from_bytes(self.lower[first // 8:(last + 7) // 8], "little")
        return (word >> first % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Position of the i-th set bit, counted from the sample before it."""
        at = int(np.frombuffer(self.samples, "<u8", 1, i // EVERY * 8)[0])
        left = i % EVERY
        if left == 0:
            return at
        start = (at + 1) // 8
        skip = (at + 1) % 8  # bits of the first byte that lie before
        while True:
            chunk = np.frombuffer(self.upper[start:start + STEP], np.uint8).copy()
            chunk[0] = chunk[0] >> skip << skip
            counts = np.cumsum(ONES[chunk])
            if counts[-1] >= left:
                break
            left -= int(counts[-1])
            start, skip = start + STEP, 0
        byte = int(np.searchsorted(counts, left))
        bits = int(chunk[byte])
        for _ in range(left - int(counts[byte - 1] if byte else 0) - 1):
            bits &= bits - 1
        return (start + byte) * 8 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.width | self.low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        if self.n == 0:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), count=self.n * self.width,
                             bitorder="little").reshape(self.n, self.width)
        low = (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return (at - np.arange(self.n)) << self.width | low
