"""Subtitle files as rows of blocks, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

ENTRY = r"(entry_[^/]+)/[^/]+$"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(entry, path, value) of whole text files; the entry is the folder named entry_*."""
    df = spark.read.text(pattern, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_path", ENTRY, 1).alias("entry"), F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def with_all(spark: SparkSession, root: str, needed: Sequence[str]) -> DataFrame:
    """Entries of a folder that have all the needed files, from the listing alone. Files without content don't count."""
    found = spark.read.format("binaryFile").load(f"{root}/entry_*/*").select(F.regexp_extract("path", ENTRY, 1).alias("entry"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return found.where(F.col("file").isin(*needed)).groupBy("entry").agg(F.countDistinct("file").alias("n")).where(F.col("n") == len(needed)).select("entry")


def _blocks(texts: DataFrame, split: str) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), split)
    rows = texts.select("entry", "path", F.posexplode(parts).alias("pos", "block"))
    return rows.withColumn("lines", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n"))


def _timed(rows: DataFrame, text: Column) -> DataFrame:
    line = F.get("lines", F.lit(1))
    ends = F.split(line, r"\s*-->\s*")
    return rows.select(
        "entry", "path", "pos", F.expr("try_cast(trim(lines[0]) AS INT)").alias("block_idx"),
        X.srt_to_ms(F.get(ends, F.lit(0))).alias("start_ms"), X.srt_to_ms(F.get(ends, F.lit(1))).alias("end_ms"), text.alias("text"),
    )


def scan_strict(texts: DataFrame) -> DataFrame:
    """Blocks of exactly three lines between blank lines; others are left out."""
    rows = _blocks(texts, "\n\n").where(F.size("lines") == 3)
    return _timed(rows, F.get("lines", F.lit(2)))


def scan_lenient(texts: DataFrame) -> DataFrame:
    """Blocks of at least two lines; further lines are the text, joined by a line break."""
    rows = _blocks(texts, r"\n\s*\n").where(F.size("lines") >= 2)
    return _timed(rows, F.array_join(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1))), "\n"))


def scan_checked(texts: DataFrame) -> DataFrame:
    """Blocks of at least three lines with valid times, after a byte order mark; text joined by spaces, ``is_full`` from its marker, which is cut off."""
    bare = texts.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    line = F.get("lines", F.lit(1))
    rows = _blocks(bare, r"\n{2,}").where((F.size("lines") >= 3) & line.rlike(f"^{X.TIME}\\s*-->\\s*{X.TIME}"))
    out = _timed(rows, F.array_join(F.transform(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(x)), " "))
    full = F.endswith("text", F.lit(X.FULL))
    return out.withColumn("is_full", full).withColumn("text", F.when(full, F.expr(f"substring(text, 1, length(text) - {len(X.FULL)})")).otherwise(F.col("text")))


def last_by_index(blocks: DataFrame) -> DataFrame:
    """One block per file and index: the last one."""
    rest = [c for c in blocks.columns if c not in ("path", "block_idx")]
    return blocks.groupBy("path", "block_idx").agg(F.max_by(F.struct(*rest), "pos").alias("b")).select("path", "block_idx", "b.*")


def with_markers(blocks: DataFrame) -> DataFrame:
    """``is_full`` and ``is_end`` from the markers at the text's end, which are cut off. Both markers together mark a sentence that is its own end."""
    both = F.endswith("text", F.lit(X.FULL + X.END))
    full, end = F.endswith("text", F.lit(X.FULL)) | both, F.endswith("text", F.lit(X.END))
    return blocks.withColumns({"is_full": full, "is_end": end}).withColumn("text", F.regexp_replace("text", f"(?:{X.FULL})?(?:{X.END})?$", ""))


def marked_text(blocks: DataFrame) -> Column:
    """The text with its markers, and its speaker's label if it has a speaker."""
    label = F.concat("speaker", F.lit(": ")) if "speaker" in blocks.columns else F.lit("")
    return F.concat(label, F.col("text"), F.when(F.col("is_full"), X.FULL).otherwise(""), F.when(F.col("is_end"), X.END).otherwise(""))


def render(blocks: DataFrame, keys: Sequence[str] = ("entry",), order: str = "pos", text: Column | None = None) -> DataFrame:
    """(keys, value): one subtitle file per group, renumbered from 1."""
    body = F.concat(X.ms_to_clock("start_ms"), F.lit(" --> "), X.ms_to_clock("end_ms"), F.lit("\n"), F.col("text") if text is None else text)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b"))))  # one recording
    numbered = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["b"]))
    return blocks.groupBy(*keys).agg(F.array_join(numbered, "\n\n").alias("value"))


def write(blocks: DataFrame, path: str, keys: Sequence[str] = ("entry",), order: str = "pos", text: Column | None = None) -> None:
    """One folder per group, each with one text file."""
    render(blocks, keys, order, text).write.partitionBy(*keys).mode("overwrite").text(path)
