"""Vectorised text features: letter trigrams and hashed words, over the bytes of a whole batch."""

from __future__ import annotations

import numpy as np

#: Byte classes of a letter trigram: 0 no letter, 1-26 a-z in either case, 27-63 bytes beyond ASCII.
CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 + (c & 0x3F) % 37 if c >= 128 else 0 for c in range(256)], np.uint32)
GRAMS = 1 << 18


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams that lie inside one row, and the row of each. Runs of non-letters count as they stand, except three in a row."""
    if len(data) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = CLASS[data]
    codes = c[:-2] << np.uint32(12) | c[1:-1] << np.uint32(6) | c[2:]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(codes)]
    inside = (codes != 0) & (np.arange(len(codes)) + 2 < at[1:][row])
    return codes[inside], row[inside]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def hashed_words(data: np.ndarray, at: np.ndarray, bits: int, lower: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (``bits`` bits) of the words of each row, and the row of each; a word is a run of ``letters``, by ``lower``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = letters[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    starts_row = at[:-1][np.diff(at) > 0]
    first[starts_row] = is_word[starts_row]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:]
    ends_row = at[1:][np.diff(at) > 0] - 1
    stop[ends_row] = is_word[ends_row]
    begin, end = np.flatnonzero(first), np.flatnonzero(stop) + 1
    powers = np.full(n, _FACTOR)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    # Dividing by the power at its start makes a word's hash the same wherever it stands.
    back = np.full(n, _INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    h = (total[end] - total[begin]) * back[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(at, begin, "right") - 1
