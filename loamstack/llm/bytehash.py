"""Vectorised 64-bit hashes of words and byte windows, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random value for each byte, and the base of the polynomial.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte is a separator of words: white space only, or everything that is neither a letter, a digit nor beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads all bits."""
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def word_hashes(texts: list[bytes], sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total): A-Z count as a-z, words are maximal runs of bytes that are no separators."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    b = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    gap = sep[b]
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    at = np.concatenate(([0], np.cumsum(sizes)))
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # where each byte stands in its word: running index less the index at the word's start
    start = np.zeros(len(b), np.int64)
    start[first] = first
    place = np.arange(len(b)) - np.maximum.accumulate(start)
    place[gap] = 0
    h = BYTE[b] * powers(int(place.max()) + 1)[place]
    h[gap] = 0
    return mix(np.add.reduceat(h, first)), np.searchsorted(first, at)


def in_pieces(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about `size` bytes together; a longer text is a piece of its own."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > size:
            yield lo, i
            lo, n = i, 0
        n += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h = h * BASE + words[j : j + n]
    return mix(h)
