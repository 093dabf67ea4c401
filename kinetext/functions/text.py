"""Scalar functions on text and time, as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Markers, times, spoken sentences, labels with stray pipes, and glosses (base, number, letters).
FULL, END = "_FULL_SENTENCE", "_END_SENTENCE"
TIME = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"
SENTENCE = r"^(?:A:|B:|C:)\s*(?:[A-ZÄÖÜ].*|(?:[0-9#]\S*(?:\s+\S+)+))$"
PIPED_LABEL = r"^(A:|B:)\s*\|+(.*)"
VARIANT = r"^([A-ZÄÖÜ]+)(\d+)?([A-Z]*)$"

#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
#: What splits words.
BLANKS = r"[ \t\n\r]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def srt_to_ms(time: Column | str) -> Column:
    """``HH:MM:SS,mmm`` as milliseconds; null where it doesn't match."""
    part = lambda i: F.regexp_extract(col(time), TIME, i).cast("long")
    return F.when(col(time).rlike(TIME), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def ms_to_clock(ms: Column | str, mark: str = ",") -> Column:
    """Milliseconds as ``HH:MM:SS,mmm`` (or with ``.`` as mark)."""
    ms = col(ms)
    unit = lambda n: F.floor(ms / n).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", unit(3_600_000), unit(60_000) % 60, unit(1000) % 60, (ms % 1000).cast("long"))


def srt_to_seconds(time: Column | str) -> Column:
    return srt_to_ms(time) / 1000


def seconds_to_clock(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("double"))


def clock_of_parts(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", h.cast("long"), m.cast("long"), s.cast("long"), ms.cast("long"))


def cap_end(start: Column | str, end: Column | str, most_ms: int = 2000) -> Column:
    """The end, at most ``most_ms`` after the start."""
    return F.least(col(end), col(start) + most_ms)


def ms_to_frame(ms: Column | str, fps: Column | float = 50) -> Column:
    """The frame at a time, truncated towards zero."""
    return (col(ms) / 1000 * fps).cast("int")


def ms_to_frames_rounded(ms: Column | str, fps: int = 50) -> Column:
    """A duration in frames, halves to the even number."""
    return F.bround(col(ms) / 1000.0 * fps).cast("int")


def clean_line(text: Column | str) -> Column:
    """A transcript line without * and ^, without pipes at its ends and after its label."""
    bare = F.btrim(F.translate(col(text), "*^", ""), F.lit("|"))
    return F.regexp_replace(bare, PIPED_LABEL, "$1 $2")


def is_sentence(text: Column | str) -> Column:
    """Whether an original line, unless it holds a gloss, is a spoken sentence: a label, then a capital, or several words after a digit or #."""
    bare = F.regexp_replace(F.regexp_replace(col(text), "[„“]", ""), "/+$", "")
    return (F.length(bare) > 4) & bare.rlike(SENTENCE)


def base_gloss(token: Column) -> Column:
    """A token without one marker at its end."""
    return F.regexp_replace(token, f"(?:{FULL}|{END})$", "")


def words(text: Column | str) -> Column:
    """Words between white space; null and blank text have none."""
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), BLANKS), "")


def normalized(text: Column | str) -> Column:
    """The text in lower case without punctuation; null stays."""
    return F.lower(F.regexp_replace(col(text), PUNCTUATION, ""))


def normalized_words(text: Column | str) -> Column:
    """Words in lower case without punctuation, in one pass over the text; words of punctuation only are dropped."""
    return words(normalized(text))


def is_upper(text: Column | str) -> Column:
    t = col(text)
    return (F.upper(t) == t) & (F.lower(t) != t)


@F.pandas_udf(StringType())
def _nfkd_ascii(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no built-in for it."""
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def safe_name(text: Column | str, default: str = "untitled", most: int | None = None) -> Column:
    """A file name of ASCII letters, digits, ``_``, ``-`` and ``.``."""
    bare = F.regexp_replace(_nfkd_ascii(col(text)), r"[^\w\-.]", "_")
    name = F.btrim(F.regexp_replace(bare, "_+", "_"), F.lit("_"))
    name = F.substring(name, 1, most) if most else name
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def gloss_variant(gloss: Column | str) -> tuple[Column, Column, Column]:
    """(base, number, letters) of a gloss such as ``HAUS1A``; base is null if it has another form."""
    g = col(gloss)
    ok = g.rlike(VARIANT)
    number = F.regexp_extract(g, VARIANT, 2)
    return F.when(ok, F.regexp_extract(g, VARIANT, 1)), F.when(ok, F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))), F.when(ok, F.regexp_extract(g, VARIANT, 3))


def comma_list(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(text)), r"\s+", ",")


def after_last(text: Column | str, mark: str = "<think>") -> Column:
    return F.trim(F.element_at(F.split(col(text), mark), -1))


def gib(size: Column | str) -> Column:
    return col(size) / float(1 << 30)


def repeats_dominate(words: list[str], min_words: int = 5, most: int = 10, share: float = 0.5) -> bool:
    """Whether one n-gram of up to ``most`` words, found more than once, makes up more than ``share`` of the words."""
    n = len(words)
    if n < min_words:
        return False
    names: dict[str, int] = {}
    single = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    gram = single
    for k in range(1, min(most, n) + 1):
        if k > 1:  # a gram is the one before it and a word: numbered anew, so that numbers stay small
            gram = gram[: n - k + 1] * len(names) + single[k - 1 :]
        _, gram, counts = np.unique(gram, return_inverse=True, return_counts=True)
        top = int(counts.max())
        if top < 2:
            return False  # then no longer gram repeats either
        if top * k / n > share:
            return True
    return False


@F.pandas_udf(BooleanType())
def _degenerate(words: pd.Series, min_words: pd.Series, most: pd.Series, share: pd.Series) -> pd.Series:
    return pd.Series([repeats_dominate(list(w), int(a), int(b), float(c)) for w, a, b, c in zip(words, min_words, most, share, strict=True)], dtype=bool)


def is_degenerate(text: Column | str, min_words: int = 5, most: int = 10, share: float = 0.5) -> Column:
    """``repeats_dominate`` of the text's words; false for null. As array expressions the n-gram counts take quadratic time, so they run over Arrow batches."""
    return _degenerate(words(text), F.lit(min_words), F.lit(most), F.lit(share))


@F.pandas_udf(ArrayType(BooleanType()))
def degenerate_flags(texts: pd.Series) -> pd.Series:
    """``repeats_dominate`` of each text of an array."""
    return texts.map(lambda xs: None if xs is None else [repeats_dominate([w for w in re.split(BLANKS, x or "") if w]) for x in xs])


def target_size(height: Column, width: Column, resolution: int, aspect: float = 9 / 16, step: int = 64) -> Column:
    """What an image is resized and then cropped to: resize_h, resize_w, crop_h, crop_w. The crop's long side is a multiple of ``step``."""
    long = int(resolution / aspect // step) * step
    tall = height > width
    crop_h, crop_w = F.when(tall, long).otherwise(resolution), F.when(tall, resolution).otherwise(long)
    ratio = height.cast("double") / width
    flat = ratio < crop_h / crop_w
    resize_h = F.when(flat, crop_h).otherwise(F.ceil(crop_w * ratio))
    resize_w = F.when(flat, F.ceil(crop_h / ratio)).otherwise(crop_w)
    return F.struct(resize_h.cast("int").alias("resize_h"), resize_w.cast("int").alias("resize_w"), crop_h.alias("crop_h"), crop_w.alias("crop_w"))
