"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _with_min(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest of u and its v. The minima are joined back, so that a hub's rows can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m0"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m0")).drop("m0")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _with_min(down)
    return found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(found.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written and read back, and where it is."""
    with C.tables_made() as made:
        return C.materialize(df, "stars"), made[-1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (a, b)."""
    now, path = _cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    before = None
    while (state := now.agg(sign).first()[0]) != before:
        before = state
        (now, new), old = _cut(_small_star(_large_star(now))), path
        C.delete(edges.sparkSession, old)
        path = new
    # Converged: every node points at its root, and roots stand only on the right.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
