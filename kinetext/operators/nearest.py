"""Exact nearest vectors, with most pairs ruled out.

On vectors of length one the cosine is a distance, so the triangle inequality
holds. Rows are filed under the nearest of some pivots, and there by their
distance to it: a piece is a ring around a pivot. A query's distance to the
pivots bounds how near any row of a piece can be. It first meets the pieces
that may be nearest, until they hold enough rows; the k-th best similarity found
there then says which other pieces it has to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Pivots, rows that they are drawn from at most, rows of a piece, and pieces at most (beyond, pieces are larger).
PIVOTS, SAMPLE, PIECE_ROWS, PIECES = 256, 20_000, 4096, 50_000
#: Queries that meet a piece in one task.
PART = 4096
SLACK = 1e-7  # of distances: bounds and similarities are rounded


def matrix(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in chunks)])
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, all of length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the one farthest from those before it: the far ones make rings thin."""
    found = [0]
    gap = apart(sample, sample[:1])[:, 0]
    while len(found) < min(n, len(sample)) and gap.max() > 1e-6:
        found.append(int(gap.argmax()))
        gap = np.minimum(gap, apart(sample, sample[found[-1:]])[:, 0])
    return sample[found]


def _filed(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                d = apart(unit(matrix(part.column("v_"))), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*part.schema.names, "cell_", "d_"])

    return run


class Map:
    """The pieces: their pivots, the least and the largest distance of their rows to it, and their numbers of rows."""

    def __init__(self, pivots: np.ndarray, rows: list) -> None:
        self.pivots = pivots
        self.piece = np.array([r["piece_"] for r in rows], np.int64)
        self.cell = np.array([r["cell_"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low_", "high_"))
        self.count = np.array([r["n_"] for r in rows], np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """How near a row of each piece can be to each query, at least."""
        d = apart(q, self.pivots)[:, self.cell]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0)


def _ask(shared, k: int, again: bool) -> Callable:
    """The pieces that each query meets: the nearest with more than k rows together; ``again``: others that may have a row as near as the k-th found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                low = at.bounds(unit(matrix(part.column("qv_"))))
                order = np.argsort(low, axis=1, kind="stable")
                held = np.cumsum(at.count[order], axis=1)
                first = np.zeros(low.shape, bool)
                np.put_along_axis(first, order, np.concatenate([np.zeros((len(low), 1), np.int64), held[:, :-1]], 1) <= k, axis=1)  # one more than k: the query may be among the rows
                if again:
                    worst = np.asarray(part.column("worst_"))  # the k-th similarity
                    reach = np.sqrt(np.maximum(2 - 2 * worst, 0)) + SLACK
                    met = ~first & (low <= reach[:, None])
                else:
                    met = first
                row, col = np.nonzero(met)
                own = part.select(["q_", "qv_"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.piece[col]), *own.columns], names=["piece_", "q_", "qv_"])

    return run


def pruned(asked: DataFrame, rows: DataFrame, k: int, best: Callable, kinds: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(q_, t_, similarity) of all rows that can be among the ``k`` nearest, for queries (q_, qv_) and rows (t_, v_) without zero vectors; and the pairs of pieces and queries that met (piece_, n_, q_).

    ``best`` keeps the best k of two tables of queries and rows.
    """
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("t_"), "t_").limit(SAMPLE).select("v_").toArrow().column("v_")
    pivots = choose_pivots(unit(matrix(sample)), PIVOTS)
    filed = materialize(rows.mapInArrow(_filed(pivots), f"t_ {kinds[1]}, v_ array<double>, cell_ int, d_ double"))
    own = filed.groupBy("cell_").agg(F.count(F.lit(1)).alias("all_"), F.min("d_").alias("from_"), F.max("d_").alias("to_"))  # a row for each pivot
    size = max(PIECE_ROWS, -(-n // PIECES))
    rings = F.ceil(F.col("all_") / size)
    ring = F.least(F.floor((F.col("d_") - F.col("from_")) / (F.col("to_") - F.col("from_") + 1e-9) * rings), rings - 1)
    ringed = filed.join(F.broadcast(own), "cell_").select("t_", "v_", "cell_", "d_", ring.cast("int").alias("ring_"))
    # Rings that hold too many rows, such as copies, are cut by hash.
    crowds = ringed.groupBy("cell_", "ring_").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("cuts_"))  # PIECES and a row for each pivot at most
    cut = ringed.join(F.broadcast(crowds), ["cell_", "ring_"]).withColumn("piece_", F.xxhash64("cell_", "ring_", F.pmod(F.xxhash64("t_"), "cuts_")))
    cut = materialize(cut.select("piece_", "cell_", "d_", "t_", "v_"))
    shape = cut.groupBy("piece_", "cell_").agg(F.min("d_").alias("low_"), F.max("d_").alias("high_"), F.count(F.lit(1)).alias("n_")).collect()
    shared = spark.sparkContext.broadcast(Map(pivots, shape))
    schema = f"piece_ long, q_ {kinds[0]}, qv_ array<double>"

    def meet(wanted: DataFrame) -> DataFrame:
        parts = wanted.groupBy("piece_").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts_"))  # a row for each piece
        lhs = wanted.join(F.broadcast(parts), "piece_").select("piece_", F.pmod(F.xxhash64("q_"), "parts_").cast("int").alias("part_"), "q_", "qv_")
        rhs = cut.join(F.broadcast(parts), "piece_").select("piece_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part_"), "t_", "v_")
        both = lhs.groupBy("piece_", "part_").cogroup(rhs.groupBy("piece_", "part_"))
        return both.applyInArrow(lambda x, y: best(x.select(["q_", "qv_"]), y.select(["t_", "v_"])), f"q_ {kinds[0]}, t_ {kinds[1]}, similarity double")

    first = materialize(asked.mapInArrow(_ask(shared, k, False), schema))
    near = materialize(meet(first))
    w = Window.partitionBy("q_").orderBy(F.desc("similarity"))
    worst = near.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).groupBy("q_").agg(F.min("similarity").alias("least_"), F.count(F.lit(1)).alias("c_"))
    # Without k rows so far, any row may be among the nearest.
    known = asked.join(worst, "q_", "left").select("q_", "qv_", F.when(F.col("c_") >= k, F.col("least_")).otherwise(F.lit(-1.0)).alias("worst_"))
    more = materialize(known.mapInArrow(_ask(shared, k, True), schema))
    met = first.select("piece_", "q_").unionByName(more.select("piece_", "q_")).join(F.broadcast(cut.groupBy("piece_").agg(F.count(F.lit(1)).alias("n_"))), "piece_")
    return near.unionByName(meet(more)), met
