"""Wavelet matrix over unsigned integers: bit-planes with rank and select support."""

from __future__ import annotations

import struct

import numpy as np

_MAGIC = b"LWM1"
#: Bits between two stored ranks.
BLOCK = 512
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    """Access, counting and occurrence lookup on a sequence of n values below 2 ** levels.

    Plane k holds bit ``levels - 1 - k`` of every value; from one plane to the next the
    values with a 0 come first, in order, then those with a 1. Plane bits are packed, and
    ranks are stored every BLOCK bits.
    """

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.levels, self.planes, self.zeros, self.ranks = n, len(planes), planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        now = np.asarray(values).astype(np.uint16 if levels <= 16 else np.uint32)
        if len(now) and int(now.max()) >> levels:
            raise ValueError("a value does not fit the planes")
        planes, zeros, ranks = [], [], []
        for k in range(levels):
            bits = (now & now.dtype.type(1 << (levels - 1 - k))) != 0
            packed = np.packbits(bits, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low = now[np.flatnonzero(~bits)]  # by places, as numpy takes much longer by a mask
            zeros.append(len(low))
            now = np.concatenate((low, now[np.flatnonzero(bits)]))
        return cls(len(values), planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        per = np.add.reduceat(_POP[packed], np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(per))).astype(np.uint32)

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // BLOCK
        start = block * (BLOCK // 8)
        whole, rest = divmod(i - block * BLOCK, 8)
        ones = int(self.ranks[k][block]) + int(_POP[self.planes[k][start : start + whole]].sum())
        if rest:
            ones += int(_POP[int(self.planes[k][start + whole]) & ((1 << rest) - 1)])
        return ones

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that value in plane k: over the stored ranks, then in one block."""
        stored = self.ranks[k].astype(np.int64)
        if not bit:
            stored = np.minimum(np.arange(len(stored), dtype=np.int64) * BLOCK, self.n) - stored
        block = int(np.searchsorted(stored, j, side="right")) - 1
        start = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[k][start : start + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(stored[block])])

    def access(self, i: int) -> int:
        """Value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = (int(self.planes[k][i >> 3]) >> (i & 7)) & 1
            ones = self.rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _down(self, value: int, i: int) -> int:
        for k in range(self.levels):
            ones = self.rank1(k, i)
            i = self.zeros[k] + ones if (value >> (self.levels - 1 - k)) & 1 else i - ones
        return i

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a value in [start, end)."""
        if value >> self.levels:
            return 0
        return self._down(value, self.n if end is None else end) - self._down(value, start)

    def occurrence(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of a value; -1 if there are fewer."""
        if value >> self.levels or j >= self.count(value):
            return -1
        i = self._down(value, 0) + j
        for k in reversed(range(self.levels)):
            bit = (value >> (self.levels - 1 - k)) & 1
            i = self.select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All values, in order: each plane, from the last, puts its two halves back in place."""
        now = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            bits = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bits)] = now[: self.zeros[k]]
            back[np.flatnonzero(bits)] = now[self.zeros[k] :] | now.dtype.type(1 << (self.levels - 1 - k))
            now = back
        return now

    def to_bytes(self) -> bytes:
        """Header, then for each plane its zeros, bits and stored ranks."""
        parts = [_MAGIC, struct.pack("<QB", self.n, self.levels)]
        for plane, zeros, ranks in zip(self.planes, self.zeros, self.ranks, strict=True):
            parts += [struct.pack("<Q", zeros), plane.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QB", data, 4)
        at, n_bytes = 13, (n + 7) // 8
        n_ranks = (n_bytes + BLOCK // 8 - 1) // (BLOCK // 8) + 1
        planes, zeros, ranks = [], [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            planes.append(np.frombuffer(data, np.uint8, n_bytes, at + 8))
            ranks.append(np.frombuffer(data, "<u4", n_ranks, at + 8 + n_bytes))
            at += 8 + n_bytes + 4 * n_ranks
        return cls(n, planes, zeros, ranks)
