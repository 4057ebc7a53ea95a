"""Elias-Fano coding of a rising sequence of whole numbers, with constant-time access through a select directory.

Of n numbers up to u, the lower l = floor(log2(u / n)) bits are stored as they are, the rest in unary: bit
(x >> l) + i of the upper part is set for number i.  That is 2 + log2(u / n) bits a number.  The directory has
the count of set bits before every 2,048 bits, 32 bits each.

Layout, little endian: n u64, u u64, l u8, number of upper bits u64, then the lower bits packed, the upper
bits packed, and the directory.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QQBQ"
_STEP = 2048


def encode(values: np.ndarray) -> bytes:
    """`values` do not fall and are not negative."""
    x = np.asarray(values, np.int64)
    n, u = len(x), int(x[-1]) if len(x) else 0
    if n and (x[0] < 0 or (np.diff(x) < 0).any()):
        raise ValueError("the values must rise from 0")
    low_bits = max(0, (u // n).bit_length() - 1) if n else 0
    size = n + (u >> low_bits) + 1
    upper = np.zeros(size, np.uint8)
    upper[(x >> low_bits) + np.arange(n)] = 1
    lower = (x[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel()
    ones = np.add.reduceat(upper, np.arange(0, size, _STEP), dtype=np.uint32)
    directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
    pack = lambda b: np.packbits(b, bitorder="little").tobytes()
    return struct.pack(_HEAD, n, u, low_bits, size) + pack(lower) + pack(upper) + directory.tobytes()


class EliasFano:
    """Reads an encoded sequence; `size` is the number of bytes that it takes."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.u, self.low_bits, bits = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        to = at + -(-self.n * self.low_bits // 8)
        self._lower = np.frombuffer(data, np.uint8, to - at, at)
        at, to = to, to + -(-bits // 8)
        self._upper = np.frombuffer(data, np.uint8, to - at, at)
        self._directory = np.frombuffer(data, "<u4", -(-bits // _STEP), to)
        self._bits = bits
        self.size = to + 4 * len(self._directory)

    def __len__(self) -> int:
        return self.n

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self._lower[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Number i: one search in the directory and one block of the upper bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self._directory, i, "right")) - 1
        bits = np.unpackbits(self._upper[block * _STEP // 8 : (block + 1) * _STEP // 8], bitorder="little")
        at = block * _STEP + int(np.flatnonzero(bits)[i - int(self._directory[block])])
        return (at - i) << self.low_bits | int(self._low(i, 1)[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the places `at`, which rise: each block of the upper bits that holds one is opened once."""
        at = np.asarray(at, np.int64)
        if len(at) and not 0 <= at[0] <= at[-1] < self.n:
            raise IndexError(at)
        block = np.searchsorted(self._directory, at, "right") - 1
        upper = np.empty(len(at), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else at
        for x, y in zip(edges, np.append(edges[1:], len(at))):
            b = int(block[x])
            bits = np.unpackbits(self._upper[b * _STEP // 8 : (b + 1) * _STEP // 8], bitorder="little")
            upper[x:y] = b * _STEP + np.flatnonzero(bits)[at[x:y] - int(self._directory[b])]
        low = self._low(int(at[0]), int(at[-1] - at[0]) + 1)[at - at[0]] if len(at) else at
        return (upper - at) << self.low_bits | low

    def all(self) -> np.ndarray:
        """All numbers."""
        at = np.flatnonzero(np.unpackbits(self._upper, bitorder="little")[: self._bits])
        return (at - np.arange(self.n)) << self.low_bits | self._low(0, self.n)
