"""Corpus scores of predictions against references: rows (id, pred, ref)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import porter
from ..functions import text as X
from . import ter as T


#: Words or letters that are compared at a time: beside its batch, a worker's memory doesn't grow with the rows of a batch.
BLOCK = 1 << 18
COUNTS = StructType([StructField(x, ArrayType(LongType())) for x in ("pred", "ref", "matches")])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and all of an executor's count together."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def count_matches(pred: list[np.ndarray], ref: list[np.ndarray], orders: range) -> np.ndarray:
    """Of each row and order: grams of either side, and matches, each gram matched as often as both have it; an array (3, rows, orders).

    Rows are lists of whole numbers that name words or letters. All rows are
    counted together: a gram is named by the one before it and its last word.
    """
    sizes = np.array([[len(x) for x in side] for side in (pred, ref)], np.int64).reshape(2, -1)
    n = sizes.shape[1]
    word = np.concatenate([np.zeros(0, np.int64), *pred, *ref])
    owner = np.repeat(np.tile(np.arange(n), 2), sizes.ravel())
    side = np.repeat([0, 1], sizes.sum(1))
    left = np.repeat(np.cumsum(sizes.ravel()), sizes.ravel()) - np.arange(len(word))  # words from here to the end of the text
    top = int(word.max(initial=0)) + 1
    place, gram, out = np.arange(len(word)), np.zeros(len(word), np.int64), np.zeros((3, n, len(orders)), np.int64)
    for k in range(1, orders.stop):
        ok = left[place] >= k
        place, gram = place[ok], gram[ok]
        names, gram = np.unique(gram * top + word[place + k - 1], return_inverse=True)
        if k not in orders:
            continue
        keys = owner[place] * max(len(names), 1) + gram
        (a, in_a), (b, in_b) = (np.unique(keys[side[place] == i], return_counts=True) for i in (0, 1))
        both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        j = k - orders.start
        out[:2, :, j] = np.maximum(sizes - k + 1, 0)
        out[2, :, j] = np.bincount(both // max(len(names), 1), np.minimum(in_a[at_a], in_b[at_b]), n)
    return out


def _size(column: pa.Array) -> np.ndarray:
    """Letters of texts, or words of lists; none for null."""
    n = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.utf8_length(column)
    return n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(*columns: pa.Array, most: int | None = None) -> Iterator[tuple[list[np.ndarray], ...]]:
    """The rows of word lists, or of strings by character, as lists of whole numbers, in blocks of about ``most`` words or letters (BLOCK; single rows may be larger).

    Letters are named by their code points, words by their place among those of the block.
    """
    ends = np.cumsum(np.concatenate([[0], sum(map(_size, columns))]))
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (most or BLOCK), "right")) - 1)
        own = [c.slice(start, stop - start) for c in columns]
        if pa.types.is_list(own[0].type):
            names = pa.concat_arrays([c.flatten() for c in own]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        else:
            names = np.frombuffer("".join(x or "" for c in own for x in c.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        rows = np.split(names, np.cumsum(np.concatenate([_size(c) for c in own]))[:-1])
        yield tuple(rows[i * (stop - start) : (i + 1) * (stop - start)] for i in range(len(columns)))
        start = stop
    give_back()


def row_matches(orders: range):
    """A column function on two word lists, or strings by character. A row's grams meet in its own task: nothing is shuffled."""

    @F.arrow_udf(COUNTS)
    def count(pred: pa.Array, ref: pa.Array) -> pa.Array:
        found = np.concatenate([np.zeros((3, 0, len(orders)), np.int64), *(count_matches(a, b, orders) for a, b in blocks(pred, ref))], 1)
        ends = pa.array(np.arange(len(pred) + 1) * len(orders), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in found], names=COUNTS.names)

    return count


def gram_matches(pairs: DataFrame, orders: range, keys: Sequence[str] = ()) -> DataFrame:
    """Per order (and key): grams of predictions and references, and matches."""
    found = row_matches(orders)("pred", "ref").alias("m")
    zipped = F.arrays_zip(F.col("m.pred").alias("pred"), F.col("m.ref").alias("ref"), F.col("m.matches").alias("matches"))
    rows = pairs.select(*keys, found).select(*keys, F.posexplode(zipped).alias("i", "x")).select(*keys, (F.col("i") + orders.start).alias("n"), "x.*")
    return rows.groupBy(*keys, "n").agg(F.sum("pred").alias("pred"), F.sum("ref").alias("ref"), F.sum("matches").alias("matches"))


def without_blanks(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")


# The rules of mteval-v13a that part punctuation from words (Spark's and SQL's expressions alike).
ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
PARTED = ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def tokens_13a(text: Column) -> Column:
    """Words and punctuation as mteval-v13a parts them; null has none."""
    out = F.coalesce(text, F.lit(""))
    for old, new in ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for rule, new in PARTED:
        out = F.regexp_replace(out, rule, new)
    return F.array_remove(F.split(out, r"\s+"), "")


def bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """Corpus BLEU-1 to BLEU-``order`` (0 to 100) over 13a tokens, with brevity penalty.

    Orders without a match are smoothed exponentially: the k-th of them counts
    as 1 / 2^k of a match. A score is 0 if no gram matches at all, or if the
    predictions have no gram of an order.
    """
    worded = pairs.select("id", tokens_13a(F.col("pred")).alias("pred"), tokens_13a(F.col("ref")).alias("ref"))
    lengths = worded.agg(F.coalesce(F.sum(F.size("pred")), F.lit(0)).alias("c"), F.coalesce(F.sum(F.size("ref")), F.lit(0)).alias("r"))
    m = gram_matches(worded, range(1, order + 1))
    cells = [F.max(F.when(F.col("n") == n, F.struct("matches", "pred"))).alias(f"o{n}") for n in range(1, order + 1)]
    row = m.agg(*cells).crossJoin(lengths)
    penalty = F.when(F.col("c") == 0, 0.0).when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    hits, total = (lambda n: F.coalesce(F.col(f"o{n}.matches"), F.lit(0))), (lambda n: F.coalesce(F.col(f"o{n}.pred"), F.lit(0)))
    scores, log, halves, lacking, any_hit = [], F.lit(0.0), F.lit(0), F.lit(False), F.lit(False)
    for n in range(1, order + 1):
        halves = halves + F.when(hits(n) == 0, 1).otherwise(0)
        lacking, any_hit = lacking | (total(n) == 0), any_hit | (hits(n) > 0)
        share = F.when(hits(n) > 0, hits(n).cast("double")).otherwise(F.pow(F.lit(0.5), halves)) / F.greatest(total(n), F.lit(1))
        log = log + F.log(share)
        scores.append(F.when(lacking | ~any_hit, 0.0).otherwise(100.0 * penalty * F.exp(log / n)).alias(f"bleu_{n}"))
    return row.select(*scores)


def chrf(pairs: DataFrame, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF (0 to 100) over character n-grams without white space; orders that either side lacks don't count."""
    bare = pairs.select(without_blanks("pred").alias("pred"), without_blanks("ref").alias("ref"))
    m = gram_matches(bare, range(1, order + 1)).where("pred > 0 and ref > 0")
    mean = m.agg(F.avg(F.col("matches") / F.col("pred")).alias("p"), F.avg(F.col("matches") / F.col("ref")).alias("r"))
    b = beta**2
    return mean.select(F.coalesce(F.try_divide((1 + b) * F.col("p") * F.col("r"), b * F.col("p") + F.col("r")) * 100, F.lit(0.0)).alias("chrf"))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Stems of the words of over three letters. A word is stemmed once for each block of them."""
    flat, out = words.flatten(), []
    for at in range(0, len(flat), BLOCK):
        own = flat.slice(at, BLOCK).dictionary_encode()
        out.append(pa.array([porter.stem(w) if len(w) > 3 else w for w in own.dictionary.to_pylist()], pa.string()).take(own.indices))
    ends = pa.array(np.cumsum(np.concatenate([[0], _size(words)])), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array([], pa.string()), *out]), mask=words.is_null())


def rouge_words(text: Column, stemmed: bool = True) -> Column:
    """Runs of a-z and 0-9 after lower-casing, with Porter's stems."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    return stems(w) if stemmed else w


def common_length(x: Sequence, y: Sequence) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict = {}
    for i, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << i
    full = v = (1 << len(y)) - 1
    for w in x:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


@F.arrow_udf(LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Longest common subsequence of two word lists."""
    return pa.array([common_length(x.tolist(), y.tolist()) for own in blocks(a, b) for x, y in zip(*own, strict=True)], pa.int64())


def f_measure(matches: Column, pred: Column, ref: Column) -> Column:
    """2PR/(P+R) as 2m/(p+r); 0 without words."""
    return F.coalesce(F.try_divide(2.0 * matches, pred + ref), F.lit(0.0))


def rouge_n(pairs: DataFrame, n: int, stemmed: bool = True) -> DataFrame:
    """Mean F of ROUGE-n over rows (0 to 100)."""
    worded = pairs.select("id", rouge_words(F.col("pred"), stemmed).alias("pred"), rouge_words(F.col("ref"), stemmed).alias("ref"))
    m = gram_matches(worded, range(n, n + 1), ["id"])
    return m.agg((F.avg(f_measure(F.col("matches"), F.col("pred"), F.col("ref"))) * 100).alias(f"rouge_{n}"))


def rouge(pairs: DataFrame, stemmed: bool = True) -> DataFrame:
    """Mean F of ROUGE-1, -2 and -L over rows (0 to 100)."""
    worded = pairs.select("id", rouge_words(F.col("pred"), stemmed).alias("pred"), rouge_words(F.col("ref"), stemmed).alias("ref"))
    m = gram_matches(worded, range(1, 3), ["id"])
    grams = m.groupBy("id").agg(*(F.sum(F.when(F.col("n") == n, f_measure(F.col("matches"), F.col("pred"), F.col("ref"))).otherwise(0.0)).alias(f"f{n}") for n in (1, 2)))
    lcs = worded.select("id", f_measure(lcs_length("pred", "ref"), F.size("pred"), F.size("ref")).alias("fl"))
    both = lcs.join(grams, "id", "left").fillna(0.0)
    return both.agg((F.avg("f1") * 100).alias("rouge_1"), (F.avg("f2") * 100).alias("rouge_2"), (F.avg("fl") * 100).alias("rouge_l"))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Word-level Levenshtein distance; a column of the table is two bit vectors over b."""
    if not b:
        return len(a)
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for w in a:
        eq = places.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(diagonal | plus) & full), plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (~(diagonal | up) & full), up & diagonal
    return score


@F.arrow_udf(LongType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edit_distance(x.tolist(), y.tolist()) for own in blocks(a, b) for x, y in zip(*own, strict=True)], pa.int64())


def _rate(pairs: DataFrame, edits, name: str, scale: float) -> DataFrame:
    worded = pairs.select(X.words("pred").alias("pred"), X.words("ref").alias("ref"))
    out = worded.select(edits("pred", "ref").alias("e"), F.size("ref").alias("n")).agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    return out.select((F.try_divide("e", "n") * scale).alias(name))


def ter(pairs: DataFrame, shift: bool = True, beam: int | None = T.BEAM) -> DataFrame:
    """Corpus translation edit rate (0 and up, in percent), without regard to case. See ``ter.edits``."""
    return T.ter(pairs, X.words, beam, shift)


def wer(pairs: DataFrame) -> DataFrame:
    """Corpus word error rate."""
    return _rate(pairs, _distance, "wer", 1.0)
