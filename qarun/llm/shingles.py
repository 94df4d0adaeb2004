"""Hashes of words, word shingles and their minima, with numpy inside Arrow batches."""

from functools import lru_cache

import numpy as np

_M = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)
_BASE = 0x9E3779B97F4A7C15


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> _32)) * _M
    values = (values ^ (values >> _32)) * _M
    return values ^ (values >> _32)


@lru_cache
def _random(n: int, seed: int) -> np.ndarray:
    odd = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)
    return odd * np.uint64(2) + np.uint64(1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash per word [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case.

    A word's hash is a polynomial over its bytes, so two prefix sums give all of them.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inner = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.r_[False, inner, False]))
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(data))
    sums = np.r_[np.uint64(0), np.cumsum(_random(256, 1)[data] * up, dtype=np.uint64)]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words.

    A text with fewer words has one shingle, its whole sequence; without words, none.
    """
    hashes = word_hashes(text or "")
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    factors = _random(2 * words + 1, 2)
    total = np.full(len(hashes) - width + 1, factors[words + width], np.uint64)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * factors[i]
    return np.unique(mixed(total))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n hash functions over a set; the largest number if it is empty."""
    xors, factors = _random(n, 3)[:, None], _random(n, 4)[:, None]
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096]
        np.minimum(least, ((part ^ xors) * factors).min(axis=1), out=least)
    return least

