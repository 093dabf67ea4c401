"""Translation edit rate (Snover and others, 2006), with the limits of its published implementations.

A prediction is turned into its reference by insertions, deletions,
substitutions and shifts of phrases, each one edit. Shifts are found greedily:
each time the one that saves the most edits. A phrase may move if the reference
has it too, not too far away, if one of its words is in error and one of the
reference's words there as well; it goes next to what its new neighbours are
aligned to. All distances of a step are computed together, row by row, within a
band around the diagonal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed limits: words of a phrase, words that it moves over, places tried for a pair in all, and the least half width of the band.
PHRASE, REACH, TRIES, BEAM = 10, 50, 1000, 25
FAR = 1 << 29
MATCH, SUBSTITUTE, DELETE, INSERT = range(4)


def bands(n: int, m: int, beam: int | None) -> list[tuple[int, int]]:
    """Of each row but the first, the columns (from, to) that are looked at."""
    if beam is None:
        return [(0, m + 1)] * n
    ratio = m / n if n else 1.0
    half = math.ceil(ratio / 2 + beam) if beam < ratio / 2 else beam
    return [(max(0, int(i * ratio) - half), m + 1 if i == n else min(m + 1, int(i * ratio) + half)) for i in range(1, n + 1)]


def _rows(preds: np.ndarray, ref: np.ndarray, beam: int | None):
    """The table's rows for predictions of equal length: first column, distances, and those by way of substitution and deletion."""
    count, n = preds.shape
    shown = np.concatenate([[-1], ref])
    low, last = 0, np.broadcast_to(np.arange(len(ref) + 1, dtype=np.int32), (count, len(ref) + 1))
    yield low, last, None, None
    for i, (lo, hi) in enumerate(bands(n, len(ref), beam)):
        above = np.full((count, hi - lo + 1), FAR, np.int32)  # columns lo - 1 to hi - 1 of the row before
        a, b = max(lo - 1, low), min(hi, low + last.shape[1])
        above[:, a - lo + 1 : b - lo + 1] = last[:, a - low : b - low]
        swap = above[:, :-1] + (preds[:, i : i + 1] != shown[None, lo:hi])
        drop = above[:, 1:] + 1
        step = np.arange(hi - lo, dtype=np.int32)
        low, last = lo, np.minimum.accumulate(np.minimum(swap, drop) - step, axis=1) + step  # insertions run along the row
        yield low, last, swap, drop


def distances(preds: np.ndarray, ref: np.ndarray, beam: int | None = BEAM) -> np.ndarray:
    """Edits without shifts of each prediction (rows of equal length; words are numbers)."""
    for _, last, _, _ in _rows(preds, ref, beam):
        pass
    return last[:, -1]


def alignment(pred: np.ndarray, ref: np.ndarray, beam: int | None = BEAM) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The edits; for each word of the reference the prediction's word that it is at (-1: before the first); which words of the prediction are in error, and which of the reference."""
    table = list(_rows(pred[None], ref, beam))
    i, j, steps = len(pred), len(ref), []
    while i or j:
        low, now, swap, drop = table[i]
        if i and j and now[0, j - low] == swap[0, j - low]:  # also in the band's first column: the word before is in the row above
            steps.append(MATCH if pred[i - 1] == ref[j - 1] else SUBSTITUTE)
            i, j = i - 1, j - 1
        elif i and now[0, j - low] == drop[0, j - low]:
            steps.append(DELETE)
            i -= 1
        else:
            steps.append(INSERT)
            j -= 1
    at, wrong, missed = np.zeros(len(ref), np.int64), np.zeros(len(pred), bool), np.zeros(len(ref), bool)
    for step in reversed(steps):
        if step == INSERT:
            at[j], missed[j] = i - 1, True
            j += 1
            continue
        wrong[i] = step != MATCH
        if step != DELETE:
            at[j], missed[j] = i, step == SUBSTITUTE
            j += 1
        i += 1
    return int(table[-1][1][0, -1]), at, wrong, missed


def moved(words: np.ndarray, start: int, length: int, to: int) -> np.ndarray:
    """A phrase taken out and put before what stood at ``to``; inside itself it moves on by so many words."""
    phrase, rest = words[start : start + length], np.delete(words, slice(start, start + length))
    spot = to if to < start else to - length if to > start + length else min(to, len(rest))
    return np.concatenate([rest[:spot], phrase, rest[spot:]])


def shifts(pred: np.ndarray, ref: np.ndarray, at: np.ndarray, wrong: np.ndarray, missed: np.ndarray, most: int) -> list[tuple[int, int, int]] | None:
    """All shifts to be tried, as (length, start, place), None if there are ``most`` or more."""
    places: dict[int, list[int]] = {}
    for j, w in enumerate(ref.tolist()):
        places.setdefault(w, []).append(j)
    wrongs, misses = np.concatenate([[0], np.cumsum(wrong)]), np.concatenate([[0], np.cumsum(missed)])
    found, tried = [], 0
    for i in np.flatnonzero(wrongs[np.minimum(np.arange(len(pred)) + PHRASE, len(pred))] > wrongs[:-1]).tolist():  # a phrase from here can be in error
        for j in places.get(int(pred[i]), ()):
            if abs(i - j) > REACH:
                continue
            for n in range(1, min(PHRASE, len(pred) - i, len(ref) - j) + 1):
                if pred[i + n - 1] != ref[j + n - 1]:
                    break
                if wrongs[i + n] == wrongs[i] or misses[j + n] == misses[j] or i <= at[j] < i + n:
                    continue
                before = None
                for k in range(j - 1, j + n):
                    to = 0 if k < 0 else int(at[k]) + 1
                    if to != before:
                        found.append((n, i, to))
                        tried += 1
                    before = to
                if tried >= most:
                    return None
    return found


def edits(pred: list[str], ref: list[str], beam: int | None = BEAM, shift: bool = True) -> int:
    """The edits of a pair of word lists. The time is bounded by TRIES distances, each of the words times the band."""
    if not ref or not pred:
        return len(pred) + len(ref)
    known: dict[str, int] = {}
    x, y = (np.array([known.setdefault(w, len(known)) for w in side], np.int32) for side in (pred, ref))
    made, tried = 0, 0
    while True:
        cost, at, wrong, missed = alignment(x, y, beam)
        if not cost or not shift:
            return cost + made
        tries = shifts(x, y, at, wrong, missed, TRIES - tried)
        if not tries:
            return cost + made
        tried += len(tries)
        own = list(dict.fromkeys(tries))
        new = np.stack([moved(x, i, n, to) for n, i, to in own])
        gain = cost - distances(new, y, beam)
        # The most edits saved, then the longest phrase, then the first one, then the first place.
        best = max(range(len(own)), key=lambda k: (gain[k], own[k][0], -own[k][1], -own[k][2]))
        if gain[best] <= 0:
            return cost + made
        x, made = new[best], made + 1


def edits_of(pred: Column, ref: Column, beam: int | None = BEAM, shift: bool = True) -> Column:
    """``edits`` of two columns of word lists; null where either is null."""

    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edits(list(x), list(y), beam, shift) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return run(pred, ref)


def ter(pairs: DataFrame, words, beam: int | None = BEAM, shift: bool = True) -> DataFrame:
    """One row, ``ter``: the edits of all pairs (pred, ref) in percent of the references' words, without regard to case. ``words`` turns a text into a list."""
    lists = pairs.select(words(F.lower("pred")).alias("pred"), words(F.lower("ref")).alias("ref"))
    counts = lists.select(edits_of(F.col("pred"), F.col("ref"), beam, shift).alias("e"), F.size("ref").alias("n")).agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    return counts.select((F.try_divide("e", "n") * 100.0).alias("ter"))
