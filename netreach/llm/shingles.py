"""Sets of hashed word shingles of whole texts, as sorted uint64 arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _STEP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _BASE)]))
    return _powers


def word_hashes(lowered: bytes) -> np.ndarray:
    """One hash for each word, words being parted by white space."""
    b = np.frombuffer(lowered, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64)
    b, space = b[starts[0]:], space[starts[0]:]
    starts -= starts[0]
    length = np.diff(np.append(starts, len(b)))
    at = np.arange(len(b)) - np.repeat(starts, length)
    value = (b.astype(np.uint64) + np.uint64(1)) * _power(int(length.max()))[at]
    value[space] = 0
    return mix(np.add.reduceat(value, starts))


def shingle_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """(id of the word sequence, sorted distinct shingles); fewer words than ``width`` make one shingle, none an empty set.

    Lower-cases A-Z only. Sequences and shingles are told apart by 64 bits.
    """
    lowered = (text or "").encode("utf-8", "surrogatepass").lower()
    words = lowered.split()
    if not words:
        return 0, np.empty(0, np.uint64)
    sid = xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1
    h = word_hashes(lowered)
    width = min(width, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        x = x * _STEP + h[k:len(h) - width + 1 + k]
    return sid, np.unique(mix(x))
