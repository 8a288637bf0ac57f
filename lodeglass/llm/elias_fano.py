"""Elias-Fano sequences over memory-mapped bytes, queried in numpy batches."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _in_bytes() -> np.ndarray:
    """By byte * 8 + k, the position of the byte's k-th (from 0) set bit."""
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        at = [b for b in range(8) if byte >> b & 1]
        out[byte, : len(at)] = at
    return out.ravel()


_IN_BYTES = _in_bytes()
_ONES, _TWOS, _FOURS, _EIGHTS, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x55, 0x33, 0x0F, 0x80))
_BYTE = np.uint64(255)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word, which has one: first the byte, by sums of the bytes' counts, then the place in it."""
    k = k.astype(np.uint64)
    x = words - ((words >> _ONE) & _TWOS)
    x = (x & _FOURS) + ((x >> np.uint64(2)) & _FOURS)
    sums = ((x + (x >> np.uint64(4))) & _EIGHTS) * _ONES  # byte b: set bits of bytes 0 to b
    place = np.bitwise_count(((k * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    k -= ((sums << np.uint64(8)) >> place) & _BYTE
    return (place + _IN_BYTES[((((words >> place) & _BYTE) << np.uint64(3)) | k).astype(np.int64)]).astype(np.int64)


def _joined(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Puts `bits` into `words` at the ascending indexes `at`."""
    if len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words[at[first]] |= np.bitwise_or.reduceat(bits, first)


class EliasFano:
    """A strictly or weakly ascending sequence of n numbers under `top`: n low parts of `low` bits, packed, and the high parts in unary."""

    def __init__(self, head: np.ndarray, lows: np.ndarray, high: np.ndarray):
        self.n, self.low, self.top = (int(x) for x in head)
        self.lows, self.high = lows.view(np.uint64), high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    @staticmethod
    def build(values: np.ndarray, top: int) -> list[np.ndarray]:
        """The arrays of the sequence, to be written; `top`: over all values."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = np.zeros((n * low + 63) // 64 + 2, np.uint64)
        if low:
            bit = np.arange(n) * low
            at, shift, part = bit >> 6, (bit & 63).astype(np.uint64), values & np.uint64((1 << low) - 1)
            _joined(lows, at, part << shift)
            over = np.flatnonzero((bit & 63) + low > 64)
            _joined(lows, at[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        size = ((top >> low) + n + 2 + 63) // 64
        words = np.zeros(size, np.uint64)
        _joined(words, high >> 6, _ONE << (high & 63).astype(np.uint64))
        return [np.array([n, low, top], np.uint64), lows.view(np.uint8), words]

    def _select(self, sums: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(sums, k, "right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_word(~bits if flip else bits, k - sums[word])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        word = (self.lows[at] >> shift) | (self.lows[at + 1] << (np.uint64(63) - shift) << _ONE)
        return word & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at indexes `i`."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(self.ones, i, False) - i).astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first number of at least `x` (each under `top`), n if there is none."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        start = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), True) + 1 - high, 0)
        end = self._select(self.zeros, high, True) - high
        low = x & np.uint64((1 << self.low) - 1) if self.low else np.zeros(len(x), np.uint64)
        a, b = start.copy(), end.copy()
        while True:  # among the few numbers with this high part
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each `x`, -1 where it is not in the sequence."""
        x = np.asarray(x, np.uint64)
        inside = x < np.uint64(self.top)
        at = np.full(len(x), -1, np.int64)
        if self.n:
            got = self.successor(x[inside])
            same = (got < self.n) & (self.access(np.minimum(got, self.n - 1)) == x[inside])
            at[np.flatnonzero(inside)[same]] = got[same]
        return at
