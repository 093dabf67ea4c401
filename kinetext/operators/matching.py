"""Matching words to glosses: exact, by variant, fuzzy, and by nearest vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from ..sources.scratch import materialize
from .joins import broadcast_if_small, is_small
from .nearest import pruned

THRESHOLD = 80.0
#: Pairs of vectors that are compared without more ado.
FEW_PAIRS = 200_000_000


def indel_ratio(a: str, b: str) -> float:
    """200 x longest common subsequence / total length; 100 for two empty strings. The subsequence is counted by bits of b."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & places.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(b) - v.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def exact_match(queries: DataFrame, glosses: DataFrame) -> DataFrame:
    known = glosses.select(F.col("gloss").alias("match")).distinct()
    return queries.join(known, F.col("q") == F.col("match"), "left")


def variant_match(queries: DataFrame, glosses: DataFrame) -> DataFrame:
    """``match``: the smallest (number, letters) variant of the query's base; a query without a number prefers numbered ones."""
    base, num, sub = X.gloss_variant("gloss")
    table = glosses.select("gloss", base.alias("base"), num.alias("num"), sub.alias("sub")).where("base is not null")
    smallest = table.groupBy("base").agg(F.min_by("gloss", F.struct("num", "sub")).alias("any_"), F.min_by("gloss", F.when(F.col("num") > 0, F.struct("num", "sub"))).alias("numbered_"))
    smallest = broadcast_if_small(smallest, F.length("any_") * 3)
    q_base = F.regexp_extract("q", X.VARIANT, 1)
    bare = F.regexp_extract("q", X.VARIANT, 2) == ""
    out = queries.withColumns({"base": F.when(F.col("q").rlike(X.VARIANT), q_base), "bare_": bare}).join(smallest, "base", "left")
    return out.withColumn("match", F.when(F.col("bare_"), F.coalesce("numbered_", "any_")).otherwise(F.col("any_"))).drop("base", "bare_", "any_", "numbered_")


#: Letters whose rarity is known; any other counts as rare.
LETTERS = 4096


def _letters(text: Column, ranks: Column) -> Column:
    """A text's letters, each with its number among equal ones, the rarest first."""
    parts = F.split(text, "")
    return F.array_sort(F.transform(parts, lambda x, i: F.struct(F.coalesce(F.try_element_at(ranks, x), F.lit(-1)).alias("r"), x.alias("x"), F.size(F.filter(F.slice(parts, 1, i), lambda y: y == x)).alias("n"))))


def fuzzy_match(queries: DataFrame, glosses: DataFrame, least: float = THRESHOLD, order: str = "idx") -> DataFrame:
    """``match``: the gloss with the best ratio of at least ``least``, the first in ``order`` on a tie.

    A pair of lengths says how many letters both must share; so one of the
    rarest letters of either, as many as may be missing and one more, must be
    among those of the other. Candidates join by length and such a letter.
    """
    asked = queries.select("q").distinct().where(F.length("q") > 0)
    part = least / 200.0  # the common subsequence must have this share of both lengths
    common = [r["x"] for r in glosses.select(F.explode(F.split("gloss", "")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c")).orderBy("c", "x").limit(LETTERS).collect()]
    ranks = F.map_from_arrays(F.array(*map(F.lit, common)), F.sequence(F.lit(0), F.lit(len(common) - 1))) if common else F.create_map(F.lit(""), F.lit(0))
    need = lambda a, b: F.ceil((a + b) * part - 1e-9).cast("int")
    shortest = lambda n: F.ceil(n * (part / (1 - part)) - 1e-9).cast("int")
    n = F.length("q")
    sized = asked.select("q", _letters(F.col("q"), ranks).alias("l_"), F.explode(F.sequence(shortest(n), F.floor(n * ((1 - part) / part) + 1e-9).cast("int"))).alias("len_"))
    keyed = sized.select("q", "len_", F.explode(F.slice("l_", F.lit(1), n - need(n, F.col("len_")) + 1)).alias("key_"))
    size = F.length("gloss")
    index = glosses.where(size > 0).select("gloss", order, size.alias("len_"), F.explode(F.slice(_letters(F.col("gloss"), ranks), F.lit(1), size - need(size, shortest(size)) + 1)).alias("key_"))
    pairs = keyed.join(index, ["len_", "key_"]).select("q", "gloss", order).distinct()
    pairs = pairs.withColumn("ratio", fuzzy_ratio("q", "gloss")).where(F.col("ratio") >= least)
    best = pairs.groupBy("q").agg(F.max_by("gloss", F.struct("ratio", -F.col(order))).alias("match"), F.max("ratio").alias("ratio"))
    return queries.join(best, "q", "left")


def nearest_cosine(queries: DataFrame, table: DataFrame, k: int = 1, q_id: str = "q_id", t_id: str = "t_id", vector: str = "embedding", skip_self: bool = False, block: int = 2048) -> DataFrame:
    """The ``k`` nearest rows by cosine, exact: q_id, t_id, similarity, rank. A zero vector has similarity 0 to all; null vectors take no part. Ties go to the smaller id.

    A stated query set against all rows. Up to FEW_PAIRS of them, queries that
    fit a broadcast meet the rows where they are; beyond, pieces of rows that
    can't hold any of the nearest are ruled out first (see ``nearest``).
    """
    asked = queries.select(F.col(q_id).alias("q_"), F.col(vector).cast("array<double>").alias("qv_")).where("qv_ is not null")
    rows = table.select(F.col(t_id).alias("t_"), F.col(vector).cast("array<double>").alias("v_")).where("v_ is not null")
    kinds = dict(queries.dtypes)[q_id], dict(table.dtypes)[t_id]
    schema = f"q_ {kinds[0]}, t_ {kinds[1]}, similarity double"
    if is_small(asked, F.size("qv_") * 8 + 16) and asked.count() * rows.count() <= FEW_PAIRS:
        got = asked.toArrow()  # SMALL_BYTES at most
        shared = queries.sparkSession.sparkContext.broadcast(got)
        found = rows.mapInArrow(lambda batches: (_best(shared.value, pa.Table.from_batches([b]), k, skip_self, lo, block) for b in batches for lo in range(0, shared.value.num_rows, block)), schema)
    else:
        # Zero vectors are as near to all, so of such rows the first few do, and for such queries the first rows.
        length = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
        keep = lambda x, y: _best(x, y, k, skip_self).combine_chunks()
        asked, rows = materialize(asked), materialize(rows)
        found, _ = pruned(asked.where(length("qv_") > 0), rows.where(length("v_") > 0), k, keep, kinds)
        few = rows.where(length("v_") == 0).orderBy("t_").limit(k + 1).unionByName(rows.orderBy("t_").limit(k + 1)).distinct().toArrow()  # two times k + 1 rows
        shared = queries.sparkSession.sparkContext.broadcast(few)
        found = found.unionByName(asked.mapInArrow(lambda batches: (_best(pa.Table.from_batches([b]), shared.value, k, skip_self, 0, b.num_rows) for b in batches), schema))
        found = found.groupBy("q_", "t_").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("q_").orderBy(F.desc("similarity"), "t_")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q_").alias(q_id), F.col("t_").alias(t_id), "similarity", "rank")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in column.chunks)])
    return flat.reshape(len(column), -1)


def _best(asked: pa.Table, rows: pa.Table, k: int, skip_self: bool, start: int = 0, length: int | None = None):
    """The k rows most similar to each query."""
    asked = asked.slice(start, length)
    if asked.num_rows and rows.num_rows:
        q, x = _matrix(asked.column(1)), _matrix(rows.column(1))
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        sim = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
        ids = np.asarray(rows.column(0))
        if skip_self:
            sim[np.asarray(asked.column(0))[:, None] == ids[None]] = -np.inf
        kept = min(k, len(ids))
        edge = np.partition(sim, len(ids) - kept, axis=1)[:, len(ids) - kept]
        row, col = np.nonzero((sim >= edge[:, None]) & np.isfinite(sim))
        order = np.lexsort((ids[col], -sim[row, col], row))
        row, col = row[order], col[order]
        ok = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[ok], col[ok]
    else:
        row = col = np.zeros(0, np.int64)
        sim = np.zeros((0, 0))
    out = [asked.column(0).combine_chunks().take(pa.array(row)), rows.column(0).combine_chunks().take(pa.array(col)), pa.array(sim[row, col])]
    names = ["q_", "t_", "similarity"]
    return pa.RecordBatch.from_arrays(out, names=names) if length is not None else pa.table(out, names=names)


def cascade(queries: DataFrame, glosses: DataFrame, nearest: DataFrame | None = None, least: float = THRESHOLD, embed=None, order: str = "idx") -> DataFrame:
    """``match`` and ``stage`` of each query ``q`` (upper-cased): exact, variant, fuzzy, else nearest.

    Each stage looks only at what the stages before left. The last one takes
    what ``nearest`` (q, match) says, or the gloss whose vector is nearest,
    where ``embed`` is a column function from words to vectors: the boundary
    to a model. Without either, what is left has no match.
    """
    asked = queries.withColumn("q", F.upper("q"))
    words = asked.select("q").distinct()
    exact = exact_match(words, glosses)
    done = exact.where("match is not null").withColumn("stage", F.lit("exact"))
    rest = exact.where("match is null").select("q")
    variant = variant_match(rest, glosses)
    done = done.unionByName(variant.where("match is not null").withColumn("stage", F.lit("variant")))
    rest = variant.where("match is null").select("q")
    fuzzy = fuzzy_match(rest, glosses, least)
    done = done.unionByName(fuzzy.where("match is not null").select("q", "match", F.lit("fuzzy").alias("stage")))
    rest = fuzzy.where("match is null").select("q")
    if nearest is None and embed is not None:
        vectors = glosses.select("gloss", F.col(order).alias("t_id"), embed(F.col("gloss")).alias("embedding"))
        numbered = rest.where("q is not null").select(F.xxhash64("q").alias("q_id"), "q", embed(F.col("q")).alias("embedding"))
        found = nearest_cosine(numbered, vectors).join(vectors.select("t_id", F.col("gloss").alias("match")), "t_id")
        nearest = numbered.select("q_id", "q").join(found, "q_id").select("q", "match")
    if nearest is not None:
        rest = rest.join(nearest.select("q", "match"), "q", "left").withColumn("stage", F.when(F.col("match").isNotNull(), "nearest").otherwise("none"))
    else:
        rest = rest.withColumns({"match": F.lit(None).cast("string"), "stage": F.lit("none")})
    return asked.join(done.unionByName(rest), "q", "left")
