"""Wavelet matrix: a sequence of token ids as one compressed bit-plane per bit, with rank and select."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"LWM1"
_HEAD = struct.Struct("<4sBQ")
_PLANE = struct.Struct("<QII")
# Bits between two stored counts of ones; a rank counts fewer than that many bits itself.
STEP = 512
# Occurrences of a token up to which each is followed up by itself.
FEW = 32


class WaveletMatrix:
    """Plane k holds bit ``bits - 1 - k`` of every id, in the order that the planes above it make: all ids with a
    zero bit first, then those with a one. Any place, count or occurrence follows one bit per plane."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.counts = n, planes, zeros, counts

    @property
    def bits(self) -> int:
        return len(self.planes)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, counts, now = [], [], [], ids
        for k in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(ones))
            counts.append(_counts(planes[-1]))
            zeros.append(len(now) - int(counts[-1][-1]))
            below = np.empty_like(now)
            np.compress(~ones, now, out=below[: zeros[-1]])
            np.compress(ones, now, out=below[zeros[-1] :])
            now = below
        return cls(len(ids), planes, zeros, counts)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [_HEAD.pack(MAGIC, self.bits, self.n)]
        for plane, zeros, counts in zip(self.planes, self.zeros, self.counts, strict=True):
            a, b = pack(plane.tobytes()), pack(counts.astype("<u4").tobytes())
            parts += [_PLANE.pack(zeros, len(a), len(b)), a, b]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, planes, zeros, counts = _HEAD.size, [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for _ in range(bits):
            zero, a, b = _PLANE.unpack_from(data, at)
            at += _PLANE.size
            zeros.append(zero)
            planes.append(np.frombuffer(unpack(data[at : at + a]), np.uint8))
            counts.append(np.frombuffer(unpack(data[at + a : at + a + b]), "<u4"))
            at += a + b
        return cls(n, planes, zeros, counts)

    def ids(self, dtype=np.uint32) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        now = np.zeros(self.n, dtype)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            now[zeros:] |= dtype(1 << k)
            above = np.empty(self.n, dtype)
            above[np.flatnonzero(~ones)] = now[:zeros]
            above[np.flatnonzero(ones)] = now[zeros:]
            now = above
        return now

    def _bit(self, k: int, i: int) -> int:
        return self.planes[k][i >> 3] >> (7 - (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block, plane = i // STEP, self.planes[k]
        whole = int(np.bitwise_count(plane[block * STEP // 8 : i >> 3]).sum())
        rest = int(plane[i >> 3] >> (8 - (i & 7))).bit_count() if i & 7 else 0
        return int(self.counts[k][block]) + whole + rest

    def _place(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit of plane k."""
        ones = self.counts[k].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * STEP, self.n) - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        start = block * STEP
        some = np.unpackbits(self.planes[k][start // 8 : (start + STEP) // 8])[: self.n - start]
        return start + int(np.flatnonzero(some == bit)[nth - before[block]])

    def access(self, i: int) -> int:
        """The id at place i."""
        token = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            token = token << 1 | int(bit)
            i = self.zeros[k] + ones if bit else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before place ``end`` lie in the last order."""
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        low, high = 0, end
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            bit = token >> (self.bits - 1 - k) & 1
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if bit else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before place ``end``."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, in order: followed up one by one if they are few, else plane by plane."""
        low, high = self._range(token, self.n)
        if high - low <= FEW:
            return np.array([self.select(token, i) for i in range(high - low)], np.int64)
        found = np.arange(low, high)
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            is_bit = np.unpackbits(self.planes[k], count=self.n) == bit
            found = np.flatnonzero(is_bit)[found - self.zeros[k] if bit else found]
        return found

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= nth < high - low:
            raise IndexError("no such occurrence")
        i = low + nth
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._place(k, bit, i - self.zeros[k] if bit else i)
        return i


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each multiple of STEP, up to the end."""
    ones = np.bitwise_count(plane)
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), STEP // 8), dtype=np.uint32) if len(ones) else np.empty(0, np.uint32)
    return np.concatenate([[0], np.cumsum(blocks, dtype=np.uint32)]).astype(np.uint32)
