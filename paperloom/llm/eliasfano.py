"""Elias-Fano sequences in memory-mapped files, queried many at a time."""

from __future__ import annotations

import os
import tempfile

import numpy as np

U = np.uint64


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after the other, in words of 64 bits."""
    parts = []
    for at in range(0, len(values) if width else 0, 1 << 13):
        bits = (values[at:at + (1 << 13), None] >> np.arange(width, dtype=U)) & U(1)
        parts.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"))
    octets = np.concatenate([*parts, np.zeros(16, np.uint8)])
    return np.concatenate([octets, np.zeros(-len(octets) % 8, np.uint8)]).view(U)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit; before[i]: set bits before word i."""
    at = np.searchsorted(before, k, "right") - 1
    word, left, place = words[at], k - before[at], at.astype(np.int64) * 64
    for width in (32, 16, 8, 4, 2, 1):
        low = word & U((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = left >= count
        word = np.where(up, word >> U(width), low)
        left = left - np.where(up, count, 0)
        place += np.where(up, width, 0)
    return place


class Sequence:
    """A non-decreasing sequence of numbers under 2 ** 64: low bits packed, high parts in unary."""

    def __init__(self, size: int, width: int, arrays: list[np.ndarray]):
        self.size, self.width = size, width
        self.low, self.high, self.ones, self.zeros = arrays

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, list[np.ndarray]]:
        values = values.astype(U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        bits = np.zeros((n + (int(high[-1]) if n else 0) + 2 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(U)
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        zeros = np.arange(len(words), dtype=np.int64) * 64 - ones
        return n, width, [_packed(values, width), words, ones, zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        bit = i.astype(np.int64) * self.width
        word, off = bit >> 6, (bit & 63).astype(U)
        value = self.low[word] >> off
        value |= np.where(off > 0, self.low[word + 1] << (U(64) - np.maximum(off, U(1))), U(0))
        return value & U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = _select(self.high, self.ones, i) - i
        return (high.astype(U) << U(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element not under x in [first, end) (end if there is none)."""
        end = np.full(len(x), self.size, np.int64) if end is None else end
        if not self.size:
            return end.copy()
        x = x.astype(U)
        high = x >> U(self.width)
        inside = high < U(len(self.high) * 64 - self.size)  # zeros in all
        h = np.where(inside, high, U(0)).astype(np.int64)
        # Elements of high part h stand between the zeros h - 1 and h.
        zeros = ~self.high
        start = np.where(h > 0, _select(zeros, self.zeros, np.maximum(h - 1, 0)) + 1 - h, 0)
        stop = _select(zeros, self.zeros, h) - h
        start, stop = np.where(inside, start, self.size), np.where(inside, stop, self.size)
        low = x & U((1 << self.width) - 1)
        lo, hi = np.clip(start, first, end), np.clip(np.minimum(stop, self.size), first, end)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            under = self._low(mid) < low[open_]
            lo[open_] = np.where(under, mid + 1, lo[open_])
            hi[open_] = np.where(under, hi[open_], mid)
        return lo


class Levels:
    """Arrays and sequences written to one file and mapped; the file has no name any more, so nothing is left behind."""

    def __init__(self):
        fd, self._path = tempfile.mkstemp(prefix="trie-")
        self._file, self._parts, self._bytes = os.fdopen(fd, "wb"), [], 0

    def add(self, array: np.ndarray) -> int:
        self._parts.append((array.dtype, len(array), self._bytes))
        data = array.tobytes()
        self._file.write(data + b"\0" * (-len(data) % 8))
        self._bytes += len(data) + -len(data) % 8
        return len(self._parts) - 1

    def add_sequence(self, values: np.ndarray) -> tuple[int, int, list[int]]:
        size, width, arrays = Sequence.encode(values)
        return size, width, [self.add(a) for a in arrays]

    def close(self) -> None:
        self._file.write(b"\0" * 8)
        self._file.close()
        self._map = np.memmap(self._path, np.uint8, "r")
        os.unlink(self._path)

    def array(self, i: int) -> np.ndarray:
        dtype, n, at = self._parts[i]
        return np.asarray(self._map[at:at + n * dtype.itemsize]).view(dtype)

    def sequence(self, made: tuple[int, int, list[int]]) -> Sequence:
        return Sequence(made[0], made[1], [self.array(i) for i in made[2]])
