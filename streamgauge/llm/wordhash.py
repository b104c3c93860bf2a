"""Vectorised word and shingle hashes over UTF-8 bytes (numpy, no per-word Python objects).

A word hash is a sum, modulo 2**64, of a pseudo-random number for each byte and its place in the word, taken for all words
of a block at once from prefix sums; a shingle hash mixes the hashes of its words. Equal words always get equal hashes;
different ones collide with probability about 2**-64 a pair. Numbers depend on the place, so that no pattern of repeated
letters cancels as in a polynomial modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_PLACES = 64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The number of a byte at a place of a word."""
    with np.errstate(over="ignore"):
        return mix(mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + byte.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


#: The numbers of the first places, by place and byte; A-Z as a-z.
_NEAR = _at(np.repeat(np.arange(_PLACES), 256), np.tile(_LOWER, _PLACES))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not blank."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the blank-separated words of UTF-8 bytes, A-Z taken as a-z."""
    start, end = words(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = np.zeros(int(size.sum()) + 1, np.uint64)
    last = np.cumsum(size)
    place = np.arange(len(total) - 1) - np.repeat(last - size, size)
    byte = data[place + np.repeat(start, size)]
    number = _NEAR[np.minimum(place, _PLACES - 1) * 256 + byte]
    if int(size.max()) > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        number[far] = _at(place[far], _LOWER[byte[far]])
    with np.errstate(over="ignore"):
        np.cumsum(number, out=total[1:])
        return mix(total[last] - total[last - size] + size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; the whole sequence as one where it has fewer words; none without words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    with np.errstate(over="ignore"):
        value = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            value = mix(value * np.uint64(0xA0761D6478BD642F) + hashes[i : n - k + 1 + i])
    return value
