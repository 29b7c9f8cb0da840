"""Vectorised tokens and rolling hashes over the bytes of many texts at once.

Used inside Arrow-batched tasks: a piece of a batch is one byte array with the
offsets of its texts, so that costs per text stay small.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: x20 and x09-x0D separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(2)
def byte_codes(family: int = 0) -> np.ndarray:
    """A code for each byte; hashes over the codes of two families are independent."""
    return mix(np.arange(1 + 256 * family, 257 + 256 * family, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_SIZE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _SIZE
    while _SIZE < n:
        _SIZE *= 2
    return _powers(_SIZE)


class Rolling:
    """Hashes of any run of ``codes``, equal for equal runs wherever they stand."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes * up[: self.n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k codes from each position."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets by text) of the words of the texts in ``data``."""
    space = IS_SPACE[data]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return Rolling(byte_codes()[data]).runs(starts, ends)


def sliding(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each run of ``size`` values."""
    m, k = x, 1
    while 2 * k <= size:
        m = pick(m[:-k], m[k:])
        k *= 2
    if k < size:
        m = pick(m[: -(size - k)], m[size - k :])
    return m


def winnow(grams: np.ndarray, size: int, offsets: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing over the texts of a piece.

    ``grams`` are the k-gram hashes of the whole piece, ``offsets`` its texts
    in tokens, and each window is ``size`` k-grams, ``tokens`` tokens in all.
    Returns (minima of the windows, by start; positions that are the minimum
    of any window inside one text). Ties are all selected, so equal windows
    select alike.
    """
    n = int(offsets[-1])
    if n < tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    minima = sliding(grams, size)
    inside = np.zeros(n + 1, np.int64)
    sizes = np.diff(offsets)
    whole = sizes >= tokens
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - tokens + 1, -1)
    valid = np.cumsum(inside)[: len(minima)] > 0
    low = np.where(valid, minima, _U(0))
    pad = np.zeros(size - 1, np.uint64)
    highest = sliding(np.concatenate([pad, low, pad]), size, np.maximum)
    return minima, np.flatnonzero((highest == grams) & (grams > 0))


def owned_ranges(grams: np.ndarray, at: np.ndarray, tokens: int, k: int):
    """Winnowing by window: (selected position, text, first and last start).

    Each window of ``tokens`` tokens belongs to the leftmost minimum of its
    k-grams; the windows of a text with the same one start in one range. Equal
    windows belong to the same place within themselves, whatever is around.
    ``at`` holds the offsets of the texts of the piece, in tokens.
    """
    minima, place = winnow(grams, tokens - k + 1, at, tokens)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    count = np.maximum(np.diff(at) - tokens + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(text)) + np.repeat(at[:-1] - np.cumsum(count) + count, count)
    # The leftmost minimum never moves back, so each start finds it among the places from itself on.
    step = np.searchsorted(place, starts)
    least = minima[starts]
    todo = np.flatnonzero(grams[place[step]] != least)
    while len(todo):
        step[todo] += 1
        todo = todo[grams[place[step[todo]]] != least[todo]]
    first = np.ones(len(starts), bool)
    first[1:] = (step[1:] != step[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(first)
    return place[step[begin]], text[begin], starts[begin], starts[np.append(begin[1:], len(starts)) - 1]


def outside(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For 0..n-1, whether no range low..high (both included) holds it."""
    if n <= 0:
        return np.zeros(0, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + 1, -1)
    return np.cumsum(edge)[:n] == 0


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of each value in the ranges low..high, both included."""
    sizes = high - low + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(np.arange(len(low)), sizes), np.arange(first[-1]) - np.repeat(first[:-1] - low, sizes)
