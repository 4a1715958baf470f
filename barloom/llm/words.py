"""Words of many texts at once, as 64-bit hashes.

A word is a run of ASCII digits and letters and of characters outside ASCII; A-Z count as a-z. In UTF-8 that is a run of
bytes, so that all texts of a slice are split together on their bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from barloom.llm.common import utf8

BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(1)
def _tables() -> tuple:
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return lower, word, mix(lower.astype(np.uint64) + _U(1))


_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = _U(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each pair of bounds, from one running sum."""
    total = _sums(values)
    _, down = powers(len(values) + 1)
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


class Words:
    """The words of a large_string array without nulls: bytes, first and last (exclusive) byte, hash, and bounds by text."""

    def __init__(self, texts: pa.Array):
        self.raw, self.text_bounds = utf8(texts)
        lower, word, table = _tables()
        is_word, b = word[self.raw], self.text_bounds
        first, last = is_word.copy(), is_word.copy()
        if len(is_word):
            first[1:] &= ~is_word[:-1]
            last[:-1] &= ~is_word[1:]
            starts = b[:-1][b[:-1] < b[1:]]
            first[starts] = is_word[starts]
            last[starts[1:] - 1] = is_word[starts[1:] - 1]
        self.first, self.last = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = runs_hash(table[self.raw], self.first, self.last)
        self.bounds = np.searchsorted(self.first, b)
        self.counts = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased and joined by spaces."""
        lower = _tables()[0]
        return b" ".join(lower[self.raw[a:b]].tobytes() for a, b in zip(self.first[i:j], self.last[i:j], strict=True))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each k consecutive words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.owner[:n] == self.owner[k - 1 :])
        return at, runs_hash(self.hash, at, at + k)
