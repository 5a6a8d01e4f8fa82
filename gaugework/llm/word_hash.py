"""Vectorised hashes of words and word shingles over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z.  Every word gets a 64-bit
hash from two cumulative sums over the bytes, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words() that end at anything but ASCII letters, digits and bytes beyond ASCII.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SHINGLE = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h = h * _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    key = f"{base}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if n <= 1 << 18:  # larger ones are cheap to make again and would stay in every worker
            _powers[key] = have
    return have[:n]


def word_places(offsets: np.ndarray, data: np.ndarray, ends: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: start, end (bytes), text number."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~ends[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = solid[cuts]
    finish[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words(offsets: np.ndarray, data: np.ndarray, ends: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_places(), then each word's hash."""
    start, end, text = word_places(offsets, data, ends)
    if not len(start):
        return start, end, text, np.zeros(0, dtype=np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    hashed = (sums[end] - sums[start]) * powers(_INVERSE, n)[start]
    return start, end, text, mix(hashed + (end - start).astype(np.uint64))


def shingles(text: np.ndarray, hashed: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every k-word shingle; a text of 1 to k - 1 words gives its whole sequence as one."""
    counts = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    whole = max(0, len(hashed) - k + 1)
    total = np.zeros(whole, dtype=np.uint64)
    for j in range(k):
        total += hashed[j : j + whole] * _SHINGLE[j]
    same = text[:whole] == text[k - 1 : k - 1 + whole] if whole else np.zeros(0, dtype=bool)
    owner, out = text[:whole][same], total[same]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = counts[short].astype(np.uint64) * _SHINGLE[40]
        for j in range(k - 1):
            has = counts[short] > j
            sums[has] += hashed[first[short[has]] + j] * _SHINGLE[j]
        owner, out = np.concatenate([owner, short]), np.concatenate([out, sums])
    return owner, mix(out)
