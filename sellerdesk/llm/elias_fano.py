"""Elias-Fano sequences over memory-mapped arrays, with vectorised operations."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


# the place of the r-th set bit of each byte
SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    SELECT[_byte, : len(_set)] = _set


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) set bit of each 64-bit word, halving the word to a byte."""
    rest, rank = words, rank.astype(np.uint8)
    place = np.zeros(len(words), np.uint64)
    for half in (32, 16, 8):
        below = np.bitwise_count(rest & U64((1 << half) - 1))
        upper = rank >= below
        rank = rank - below * upper
        shift = upper * U64(half)
        rest = rest >> shift
        place += shift
    return place.view(np.int64) + SELECT[(rest & U64(255)).view(np.int64), np.minimum(rank, 7)]


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` below 2^bits in ``bits`` bits each, as little-endian 64-bit words."""
    out = np.zeros((len(values) * bits >> 6) + 3, np.uint64)
    if not bits or not len(values):
        return out
    values = values.astype(np.uint64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    start = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[start]] = np.bitwise_or.reduceat(values << shift, start)
    over = np.flatnonzero(shift + U64(bits) > U64(64))  # at most one value runs over the end of a word
    out[word[over] + 1] |= values[over] >> (U64(64) - shift[over])
    return out


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of the strictly increasing ``values`` below ``universe``."""
    values = values.astype(np.uint64)
    n = max(len(values), 1)
    bits = max(0, (universe // n).bit_length() - 1)
    high = (values >> U64(bits)).astype(np.int64)
    size = len(values) + (universe >> bits) + 1
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[high + np.arange(len(values))] = 1
    upper = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    zeros = 64 * np.arange(len(upper), dtype=np.int64) - np.concatenate(([0], ones[:-1]))
    return {
        "shape": np.array([len(values), bits], np.int64),
        "low": pack_bits(values & U64((1 << bits) - 1), bits),
        "upper": upper,
        "zeros": zeros.astype(np.uint32),  # zeros before each word, of one shard
    }


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["shape"])
        self.low, self.upper, self.zeros = arrays["low"], arrays["upper"], arrays["zeros"]
        self.ones = None
        self.top = self.at(np.array([self.n - 1]))[0] if self.n else U64(0)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        # a shift by 64 is undefined, so the second word is shifted in two steps
        second = (self.low[word + 1] << U64(1)) << (U64(63) - shift)
        return (first | second) & U64((1 << self.bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        rank = k - self.zeros[word].astype(np.int64)
        return word * 64 + _select_in_word(~self.upper[word], rank)

    def _place(self, i: np.ndarray) -> np.ndarray:
        """The places of the i-th set bits."""
        if self.ones is None:  # set bits before each word
            self.ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word * 64 + _select_in_word(self.upper[word], i - self.ones[word])

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(np.uint64) << U64(self.bits)) | self._low(i)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at indices."""
        i = np.asarray(i, np.int64)
        return self._value(i, self._place(i))

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at indices and at the indices after them."""
        place = self._place(i)
        rest = self.upper[place >> 6] >> (place & 63).astype(np.uint64) >> U64(1)
        after = place + 1 + np.bitwise_count((rest & -rest) - U64(1))
        far = np.flatnonzero(rest == 0)  # the next set bit is in a later word
        after[far] = self._place(i[far] + 1)
        return self._value(i, place), self._value(i + 1, after)

    def values(self) -> np.ndarray:
        """All values (for tests and small sequences)."""
        flags = np.unpackbits(np.asarray(self.upper).view(np.uint8), bitorder="little")
        high = np.flatnonzero(flags)[: self.n] - np.arange(self.n)
        return (high.astype(np.uint64) << U64(self.bits)) | self._low(np.arange(self.n))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, found) of each ``x`` (below the universe); index is that of the successor."""
        x = x.astype(np.uint64)
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> U64(self.bits)).astype(np.int64)
        want = x & U64((1 << self.bits) - 1)
        # values with equal high bits are a run of set bits, between two zeros
        begin = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) + 1, 0)
        left = begin - high
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        bits = self.upper[word] >> shift
        after = self.upper[np.minimum(word + 1, len(self.upper) - 1)]
        bits |= (after << U64(1)) << (U64(63) - shift)
        run = np.bitwise_count(bits & ~(bits + U64(1))).astype(np.int64)
        full = np.flatnonzero((run >= 64) | (begin + run >= 64 * len(self.upper)))
        stop = left + run
        stop[full] = self._select0(high[full]) - high[full]
        right = stop.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):  # binary search among the values with equal high bits
            mid = (left[open_] + right[open_]) >> 1
            less = self._low(mid) < want[open_]
            left[open_] = np.where(less, mid + 1, left[open_])
            right[open_] = np.where(less, right[open_], mid)
            open_ = open_[left[open_] < right[open_]]
        inside = left < stop
        found = np.zeros(len(x), bool)
        found[inside] = self._low(left[inside]) == want[inside]
        return left, found
