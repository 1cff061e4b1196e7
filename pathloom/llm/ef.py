"""Elias-Fano sequences over arrays that may be memory-mapped, many queries at a time."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lowest(w: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit, 64 where there is none."""
    return np.bitwise_count((w & (~w + ONE)) - ONE).astype(np.int64)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    at = np.zeros(len(w), np.uint64)
    k = k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((w >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= low
        k = np.where(up, k - low, k)
        at = np.where(up, at + np.uint64(half), at)
    return at.astype(np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and counts of
    ones by word for select and rank."""

    PARTS = ("low", "high", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros((n + (top >> width) + 2 + 63) // 64 + 1, np.uint64)
        at = (v >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), ONE << (at & np.uint64(63)))
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            bits = v & np.uint64((1 << width) - 1)
            off = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, sh = (off >> np.uint64(6)).astype(np.int64), off & np.uint64(63)
            np.bitwise_or.at(low, word, bits << sh)
            over = sh + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (np.uint64(64) - sh[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, width, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        off = i.astype(np.uint64) * np.uint64(self.width)
        word, sh = (off >> np.uint64(6)).astype(np.int64), off & np.uint64(63)
        rest = np.where(sh == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - sh) & np.uint64(63)))
        return ((self.low[word] >> sh) | rest) & np.uint64((1 << self.width) - 1)

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one of the high bits."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word])

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def access(self, i: np.ndarray) -> np.ndarray:
        return self._value(i, self._place(i))

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements i and i + 1; the second mostly stands in the same word."""
        at = self._place(i)
        rest = self.high[at >> 6] & (ALL << (at & 63).astype(np.uint64) << ONE)
        rest = np.where((at & 63) == 63, np.uint64(0), rest)
        after = (at & ~63) + _lowest(rest)
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self._place(i[far] + 1)
        return self._value(i, at), self._value(i + 1, after)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        if not hasattr(self, "zeros"):
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(self.zeros, k, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, -1 where it isn't there; searched only in [lo, hi) where given."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.width)).astype(np.int64)
        last = (len(self.high) * 64 - self.n) - 1
        inside = h < last
        h = np.minimum(h, last - 1)
        # a bucket's elements are the ones between two zeros, mostly in one word
        at = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0)
        a = at - h
        run = _lowest(~(self.high[at >> 6] >> (at & 63).astype(np.uint64)))
        b = a + run
        far = np.flatnonzero((at & 63) + run >= 64)
        if len(far):
            b[far] = self._zero(h[far]) - h[far]
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        want = x & np.uint64((1 << self.width) - 1)
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        ok = inside & (a < end) & (a < self.n)
        ok &= self._low(np.where(ok, a, 0)) == want if self.n else False
        return np.where(ok, a, -1)
