"""Elias-Fano coding of monotone integers, in flat little-endian arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i
ONE = np.uint64(1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, little-endian, as 64-bit words with one word to spare."""
    packed = np.packbits(bits, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(8 - len(packed) % 8 + 8), "<u8")


class EliasFano:
    """n ascending integers: low bits packed; high parts in unary, with counts of ones before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        highs = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(highs[-1]) if n else 0) + 1, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = _words(bits)
        ones = np.zeros(len(high) + 1, "<u8")
        ones[1:] = np.cumsum(_POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64))
        parts = []
        for lo in range(0, n, 1 << 16):  # 2**16 values end on a byte
            some = values[lo : lo + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64) & ONE
            parts.append(np.packbits(some.astype(np.uint8).ravel(), bitorder="little"))
        raw = b"".join(p.tobytes() for p in parts)
        return cls(n, low_bits, np.frombuffer(raw + bytes(8 - len(raw) % 8 + 8), "<u8"), high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8"), self.low, self.high, self.ones]

    @classmethod
    def mapped(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From 64-bit words at a place; also where the next thing begins."""
        n, low_bits, n_low, n_high = (int(x) for x in words[at : at + 4])
        at += 4
        cuts = np.cumsum([at, n_low, n_high, n_high + 1])
        low, high, ones = (words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return cls(n, low_bits, low, high, ones), int(cuts[-1])

    def _in_word(self, words: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The place of the rest-th one (from 0) in each 64-bit word."""
        octets = words.astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.cumsum(_POP[octets], axis=1, dtype=np.uint8)
        byte = (counts <= rest[:, None]).sum(1)
        rows = np.arange(len(words))
        before = np.where(byte > 0, counts[rows, byte - 1], 0)
        return byte * 8 + _SELECT[octets[rows, byte], rest - before]

    def _select_one(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint64), "right") - 1
        return word * 64 + self._in_word(self.high[word], i - self.ones[word].astype(np.int64))

    def _select_zero(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th zero; a binary search over words, whose zeros before are 64 w - ones."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), len(self.high), np.int64)
        while (open_ := hi - lo > 1).any():
            mid = (lo + hi) >> 1
            left = 64 * mid - self.ones[mid].astype(np.int64) <= i
            lo, hi = np.where(open_ & left, mid, lo), np.where(open_ & ~left, mid, hi)
        return lo * 64 + self._in_word(~self.high[lo], i - (64 * lo - self.ones[lo].astype(np.int64)))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift | self.low[word + 1] << ONE << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self._select_one(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1 where it isn't there."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        highs = (values >> np.uint64(self.low_bits)).astype(np.int64)
        top = int(self._select_one(np.array([self.n - 1]))[0]) - (self.n - 1)
        inside = np.flatnonzero(highs <= top)
        if not len(inside):
            return out
        highs, want = highs[inside], values[inside] & np.uint64((1 << self.low_bits) - 1)
        lo = np.where(highs > 0, self._select_zero(np.maximum(highs - 1, 0)) - highs + 1, 0)
        end = np.minimum(self._select_zero(highs) - highs, self.n)
        hi = end
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = self._lows(np.minimum(mid, self.n - 1)) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        hit = lo < end
        hit[hit] = self._lows(lo[hit]) == want[hit]
        out[inside[hit]] = lo[hit]
        return out
