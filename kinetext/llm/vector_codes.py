"""Product codes of vectors, with VA-file filtering.

Vectors are cut into parts, and each part is coded by its nearest codebook
entry. The coordinates of the entries are quantised into a few cells each. For
a part, a table gives the least and the largest squared distance from its
coordinates to every cell; sums over the table bound its distance to all
entries, and only entries whose lower bound is within the least upper bound are
compared, in whole numbers. Codebooks are means in whole numbers as well, so
results don't depend on the order of rows, and are the same on any cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell's number, and parts whose bounds are computed at a time.
CELL_BITS, BLOCK = 2, 2048
#: No sum of squares may pass this; a component is limited to what keeps it.
MOST = 1 << 62


def limit(dims: int) -> int:
    """The largest whole number that a component may be: beyond it, it counts as this."""
    return int((MOST / max(1, dims)) ** 0.5) // 2


@dataclass
class Cells:
    """One part's entries: their coordinates, and the cell of each coordinate."""

    entries: np.ndarray  # entries x width, whole numbers

    def __post_init__(self) -> None:
        n, width = self.entries.shape
        cells = 1 << CELL_BITS
        ranked = np.sort(self.entries, axis=0)
        cuts = ranked[(np.arange(1, cells) * n) // cells] if n else np.zeros((cells - 1, width), np.int64)  # equally many entries a cell
        self.cell = (self.entries[:, None, :] >= cuts[None]).sum(1)  # entries x width
        # The entries' own least and largest coordinate in each cell; an empty cell has no entry to bound.
        self.low = np.zeros((cells, width), np.int64)
        self.high = np.zeros((cells, width), np.int64)
        for c in range(cells):
            own = self.cell == c
            self.low[c] = np.where(own, self.entries, np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max)
            self.high[c] = np.where(own, self.entries, np.iinfo(np.int64).min).max(0, initial=np.iinfo(np.int64).min)
            none = ~own.any(0)
            self.low[c, none] = self.high[c, none] = 0
        at = np.zeros((cells * width, n))
        at[(self.cell * width + np.arange(width)).T, np.arange(n)] = 1  # which table rows an entry's bounds sum
        self.at = at

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row of x to each entry."""
        under, over = self.low[None] - x[:, None, :], x[:, None, :] - self.high[None]
        least = np.maximum(np.maximum(under, over), 0).astype(float)
        most = np.maximum(np.abs(under), np.abs(over)).astype(float)
        n = len(x)
        return (least * least).reshape(n, -1) @ self.at, (most * most).reshape(n, -1) @ self.at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (the first of equals), its squared distance, and how many entries were compared."""
        n = len(x)
        low, high = self.bounds(x)
        edge = high.min(1, keepdims=True)
        row, col = np.nonzero(low <= edge * (1 + 1e-9))  # sums of floats may be off by a rounding
        d = ((x[row] - self.entries[col]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(d, starts) if n else d
        first = np.flatnonzero(d == best[row])  # in the order of rows, then entries
        keep = first[np.concatenate([[True], row[first][1:] != row[first][:-1]])[: len(first)]]
        return col[keep], best, len(row)


def whole_vectors(table: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null and has no null or non-finite component; the vector as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.withColumn(vector_col, v).where(F.col(f"`{vector_col}`").isNotNull() & F.coalesce(sound, F.lit(False)))


def whole_numbers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows x dims: floor(scale * x), zero beyond a vector's end."""
    at = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)[at[0] : at[-1]] if len(column) else np.zeros(0)
    most = limit(dims)
    own = np.clip(np.floor(flat * float(scale)), -most, most).astype(np.int64)
    out, size = np.zeros((len(column), dims), np.int64), np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = own
    return out


def coded(column: pa.Array, books: np.ndarray, cells: list[Cells], scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole numbers (rows x parts x width), codes and squared distances (rows x parts)."""
    parts, _, width = books.shape
    x = whole_numbers(column, parts * width, scale).reshape(len(column), parts, width)
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p, own in enumerate(cells):
        codes[:, p], errors[:, p], _ = own.nearest(x[:, p])
    return x, codes, errors


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield batch.slice(lo, BLOCK)


def _sums(books, scale: int):
    """Per entry and position the sum of the parts that it is nearest to, and (at position -1) their number: one row each a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.value.shape
        cells = [Cells(x) for x in books.value]
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for part in _pieces(batches):
            x, codes, _ = coded(part.column("v"), books.value, cells, scale)
            spot = (codes + np.arange(parts) * entries).ravel()
            np.add.at(total, spot, x.reshape(len(spot), width))
            count += np.bincount(spot, minlength=parts * entries)
        used = np.flatnonzero(count)
        spot = np.concatenate([np.repeat(used, width), used])
        at = np.concatenate([np.tile(np.arange(width), len(used)), np.full(len(used), -1)])
        value = np.concatenate([total[used].ravel(), count[used]])
        yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(value)], names=["spot", "at", "value"])

    return run


def fit(vectors: DataFrame, first: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """The codebooks (parts x entries x width) after some rounds from ``first``.

    Sums are added on the executors; the driver gets a number for each component of the codebooks.
    """
    spark, books = vectors.sparkSession, first
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        parts, entries, width = books.shape
        found = vectors.select("v").mapInArrow(_sums(shared, scale), "spot int, at int, value long").groupBy("spot", "at").agg(F.sum("value").alias("value")).toArrow()
        shared.destroy()
        spot, at, value = (np.asarray(found.column(c)).astype(np.int64) for c in ("spot", "at", "value"))
        total, count = books.reshape(parts * entries, width).copy(), np.zeros(parts * entries, np.int64)
        count[spot[at < 0]] = value[at < 0]
        total[spot[at >= 0], at[at >= 0]] = value[at >= 0]
        used = count > 0
        total[used] = total[used] // count[used, None]
        books = total.reshape(books.shape)
    return books


def encode(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """The codes of all vectors: the columns of ``table`` but the vector, plus code, error, label_error and codebooks_sha256.

    A component x counts as floor(``scale`` * x). Codebooks start as the parts
    of the vectors with the ``entries`` smallest ids (null last, equal ids in
    the order of their vectors), fewer if there are fewer vectors, and each
    round replaces an entry by the floor of the mean of the parts nearest to it
    (the first of equally near entries). ``code`` has the entries' numbers in
    two hex digits (as many as are needed, beyond 256 entries) a part, ``error``
    the squared distances summed, ``label_error`` their sum over equal labels
    (nulls are equal; null if it doesn't fit 64 bits), ``codebooks_sha256`` the
    digest of the entries' components, joined by commas.

    Rows whose vector is null or has a null or non-finite component are
    dropped. Vectors are filled up with zeros to the longest one and to equal
    parts; components whose squares would not fit 64 bits are limited to those
    that do (beyond 2^17 for 64 dimensions). Repeated rows are rows. An empty
    table gives an empty table. Columns named like a new one are replaced.
    """
    spark = table.sparkSession
    new = ("code", "error", "label_error", "codebooks_sha256")
    kept = [c for c in table.columns if c.lower() not in new and c.lower() != vector_col.lower()]
    sound = whole_vectors(table, vector_col)
    vectors = sound.select(F.col(f"`{vector_col}`").alias("v"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    seeds = sound.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = whole_numbers(seeds.column("v").combine_chunks(), parts * width, scale) if seeds.num_rows else np.zeros((0, parts * width), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    if len(start):
        books = fit(vectors, books, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)  # entries x dimensions
    digits = max(2, len(f"{max(1, entries) - 1:x}"))
    fields = [f for f in sound.schema.fields if f.name in kept]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(x) for x in shared.value]
        for part in _pieces(batches):
            _, codes, errors = coded(part.column(vector_col), shared.value, cells, scale)
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(text, pa.string()), pa.array(errors.sum(1))], names=[*names, "code", "error"])

    out = C.materialize(sound.mapInArrow(run, schema), "codes")
    key, total = C.free_name(out, "__key"), C.free_name(out, "__total")
    sums = out.groupBy(F.col(f"`{label_col}`").alias(key)).agg(F.try_sum("error").alias(total))
    sums = C.sized_broadcast(sums, F.length(F.col(key).cast("string")) + 16)
    out = out.join(sums, F.col(f"`{label_col}`").eqNullSafe(F.col(key)), "left").withColumn("label_error", F.col(total))
    return out.select(*(F.col(f"`{c}`") for c in names), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
