"""Removal of lines that several documents share.

Two Bloom filters, for keys seen once and keys seen twice, are filled task by
task and merged; only lines that the second filter suspects are shuffled, as
16-byte digests, to be confirmed exactly and to find their first document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bits of a filter: this many for each line, up to a bound that any worker can hold. Beyond the bound the
#: filters fill up, more lines are suspected and shuffled, and the result stays the same.
BITS_A_LINE, LEAST_BITS, MOST_BITS, SEGMENT_BITS, PROBES = 16, 1 << 20, 1 << 29, 1 << 22, 3
#: Tasks a core that fill filters, at most, and filters that one task merges: more are merged in two levels.
FILL_TASKS, MERGE = 4, 64
FOLD = 1 << 19


class Bloom:
    """A bit array; ``PROBES`` bits a key, by double hashing of a 64-bit hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask, self.data = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8) if data is None else data

    def _bits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            at = (h + np.uint64(i) * step) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._bits(h):
            np.bitwise_or.at(self.data, at, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at, bit in self._bits(h):
            found &= (self.data[at] & bit) != 0
        return found


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    keys = [x.strip().lower() for x in text.split(b"\n")]  # bytes: only ASCII blanks are stripped, only A-Z lower-cased
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys]


def _fill(bits: int, min_chars: int):
    """Filters of one task, as compressed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, wait = Bloom(bits), Bloom(bits), []

        def fold() -> None:
            h, n = np.unique(np.array(wait, np.uint64), return_counts=True)
            twice.add(h[(n > 1) | once.has(h)])
            once.add(h)
            wait.clear()

        last, seen = None, set()  # rows of one document may follow one another
        for batch in batches:
            for part in C.slices(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), C.texts(part.column("text")), strict=True):
                    if doc != last:
                        last, seen = doc, set()
                    new = {k for k in line_keys(text, min_chars) if k is not None} - seen
                    seen |= new
                    wait += [xxhash.xxh3_64_intdigest(k) for k in new]
                    if len(wait) >= FOLD:
                        fold()
        fold()
        width = min(bits, SEGMENT_BITS) // 8
        for i in range(bits // 8 // width):
            a, b = once.data[i * width : (i + 1) * width], twice.data[i * width : (i + 1) * width]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], names=["segment", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal segments as they stream by: seen twice is what either side saw twice or both saw once."""
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, *both in zip(*(batch.column(k).to_pylist() for k in ("segment", "once", "twice")), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in both)
            if i in merged:
                once, twice = merged[i]
                merged[i] = [once | a, twice | b | (once & a)]
            else:
                merged[i] = [a, b]
    for i, both in merged.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in both)], names=["segment", "once", "twice"])


def _suspects(filter_parts, bits: int, min_chars: int):
    """Digest and document of each line that the filter of twice-seen keys has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, width = Bloom(bits), min(bits, SEGMENT_BITS) // 8
        for i, blob in filter_parts.value:
            bloom.data[i * width : (i + 1) * width] = np.frombuffer(zlib.decompress(blob), np.uint8)
        for batch in batches:
            for part in C.slices(batch, "text"):
                docs, keys = [], []
                for doc, text in zip(zip(part.column("doc").to_pylist(), part.column("part").to_pylist(), strict=True), C.texts(part.column("text")), strict=True):
                    own = [k for k in dict.fromkeys(line_keys(text, min_chars)) if k is not None]
                    docs += [doc] * len(own)
                    keys += own
                hit = np.flatnonzero(bloom.has(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
                yield pa.RecordBatch.from_arrays([*(pa.array([docs[i][x] for i in hit], pa.int64()) for x in (0, 1)), pa.array([blake2b(keys[i], digest_size=16).digest() for i in hit], pa.binary())], names=["doc", "part", "digest"])

    return run


def document_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a line's document is compared by, and what tells the rows apart that have no id: those are one document, but don't lose their lines in one place."""
    number = F.col(f"`{id_col}`").cast("long")
    return F.coalesce(number, F.lit(C.NO_ID)), F.when(number.isNull(), F.xxhash64(F.col(f"`{text_col}`").cast("string"))).otherwise(F.lit(0).cast("long"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Per document, the digests of the lines it loses: columns ``doc``, ``part`` and ``lost`` (array of binary). See ``document_keys``."""
    spark = docs.sparkSession
    texts = docs.select(*(k.alias(n) for k, n in zip(document_keys(id_col, text_col), ("doc", "part"), strict=True)), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n = docs.agg(F.sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long") + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_A_LINE):
        bits *= 2
    # A filter is as large for one split as for many: few tasks fill them, however many splits there are.
    few, columns = spark.sparkContext.defaultParallelism * FILL_TASKS, "segment int, once binary, twice binary"
    segments, shares = max(1, bits // SEGMENT_BITS), -(-few // MERGE)
    filters = texts.coalesce(few).mapInArrow(_fill(bits, min_chars), columns)
    if shares > 1:  # no task merges a segment of all filters at once
        filters = filters.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(shares))).repartition(segments * shares, "segment", "share").select("segment", "once", "twice").mapInArrow(_merge, columns)
    merged = filters.repartition(segments, "segment").mapInArrow(_merge, columns).select("segment", "twice").collect()  # MOST_BITS bounds it
    parts = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in merged])
    suspects = C.materialize(C.gathered(texts.mapInArrow(_suspects(parts, bits, min_chars), "doc long, part long, digest binary")), "suspects")
    first = suspects.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    first = C.materialize(first, "first")
    lost = suspects.join(first, "digest").where("doc > first")
    return C.materialize(lost.groupBy("doc", "part").agg(F.collect_set("digest").alias("lost")), "lost")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Drop repeated lines everywhere but in the document with the smallest id.

    A line's key is the line stripped of ASCII white space and with A-Z
    lower-cased; keys under ``min_chars`` code points never count. Returns the
    columns of ``docs`` with the text rewritten, plus ``n_lines`` (before) and
    ``n_dropped``.

    Null or empty text is one empty line (and stays null or empty). Rows with
    the same id are one document. Documents with a null id count as one
    document with the largest id. Ids are whole numbers; others that can't be
    read as such raise an error. An empty table gives an empty table. Columns
    of ``docs`` named like a new column are replaced.
    """
    lost = repeated_lines(docs, id_col, text_col, min_chars)
    lost = C.sized_broadcast(lost, F.size("lost") * 24)
    columns, docs = docs.columns, C.as_text(docs, text_col)
    key, part_key, bag = (C.free_name(docs, x) for x in ("__doc", "__part", "__lost"))
    side = lost.select(F.col("doc").alias(key), F.col("part").alias(part_key), F.col("lost").alias(bag))
    joined = docs.withColumns(dict(zip((key, part_key), document_keys(id_col, text_col), strict=True))).join(side, [key, part_key], "left")

    def rewrite(part: pa.RecordBatch) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for text, gone, null in zip(C.texts(part.column(text_col)), part.column(bag).to_pylist(), part.column(text_col).is_null().to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = lines
            if gone:
                gone = set(gone)
                kept = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if k is None or blake2b(k, digest_size=16).digest() not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(None if null else text if len(kept) == len(lines) else b"\n".join(kept))
        return {text_col: C.text_array(texts), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = C.add_columns(joined, rewrite, fields, text_col, drop=(key, part_key, bag))
    return out.select([F.col(f"`{c}`") for c in columns if c.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"])
