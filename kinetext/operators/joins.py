"""Joins that Spark does not plan well by itself, rewritten as equi joins, and helpers for global order."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .terms import terms_in

#: Rows and bytes of a dimension that is turned into one expression or broadcast.
SMALL_ROWS, SMALL_BYTES = 20_000, 8 << 20


def is_small(df: DataFrame, size_of: Column, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether a dimension is within the bounds; counts at most ``rows`` + 1 rows of it."""
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size_of), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, size_of: Column) -> DataFrame:
    return F.broadcast(df) if is_small(df, size_of) else df


def trie_regex(terms: Sequence[str]) -> str:
    """An expression that finds any of the terms (none empty), branching letter by letter, so that a place costs few comparisons however many terms there are. A term with another one as prefix adds nothing."""
    root: dict = {}
    for t in sorted(set(terms), key=len):
        node = root
        for i, ch in enumerate(t):
            if node is None:
                break
            node = node.setdefault(ch, {} if i < len(t) - 1 else None)

    def render(node: dict) -> str:
        parts = []
        for ch, below in sorted(node.items()):
            tail = re.escape(ch)
            while below is not None and len(below) == 1:  # a straight run needs no group
                ((ch, below),) = below.items()
                tail += re.escape(ch)
            parts.append(tail if below is None else f"{tail}{render(below)}")
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return render(root)


def contains_any(lines: DataFrame, terms: DataFrame, text: str, term: str, out: str = "found", strip: str = "^") -> DataFrame:
    """``out``: whether the text contains any of the terms, each without ``strip`` at its end. A null text contains none.

    A bounded list of terms becomes one expression, evaluated in the scan; a
    longer one an automaton that the texts pass.
    """
    strip_end = F.regexp_replace(F.col(term), "[" + re.escape(strip) + "]+$", "") if strip else F.col(term)
    wanted = terms.select(strip_end.alias("t_")).where("t_ is not null").distinct()
    if is_small(wanted, F.length("t_")):
        found = sorted((r["t_"] for r in wanted.collect()), key=lambda t: (len(t), t))  # SMALL_ROWS at most
        if not found:
            return lines.withColumn(out, F.lit(False))
        if found[0] == "":
            return lines.withColumn(out, F.col(text).isNotNull())
        return lines.withColumn(out, F.coalesce(F.col(text).rlike(trie_regex(found)), F.lit(False)))
    marked = terms_in(lines.withColumn("text_", F.col(text).cast("string")), wanted, "text_", "t_", "terms_", first=True)
    empty = not wanted.where("t_ = ''").isEmpty()
    return marked.withColumn(out, F.when(F.lit(empty), F.col(text).isNotNull()).otherwise(F.size("terms_") > 0)).drop("text_", "terms_")


#: Terms that a scan looks for one by one.
FEW_TERMS = 64


def term_search(blocks: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """Each block with each term that it contains, without a cross join: few terms are looked for in the scan, more by an automaton that the texts pass. See ``terms.term_positions`` for places."""
    wanted = terms.select(term).where(F.length(term) > 0).distinct()
    few = [r[0] for r in wanted.limit(FEW_TERMS + 1).collect()]
    if len(few) > FEW_TERMS:
        return terms_in(blocks, wanted, text, term, "terms_").withColumn(term, F.explode("terms_")).drop("terms_")
    if not few:
        return blocks.withColumn(term, F.lit(None).cast("string")).limit(0)
    found = F.filter(F.array(*(F.lit(t) for t in sorted(few))), lambda t: F.col(text).contains(t))
    return blocks.withColumn(term, F.explode(found))


def anti_join(train: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of train whose trimmed keys are not in holdout; null keys never match."""
    other = holdout.select(*(F.trim(F.col(k)).alias(f"{k}_r") for k in keys)).distinct()
    on = None
    for k in keys:
        eq = F.trim(F.col(k)) == F.col(f"{k}_r")
        on = eq if on is None else on & eq
    return train.join(other, on, "left_anti")


def touching_blocks(outliers: DataFrame, blocks: DataFrame, others: DataFrame, keys: Sequence[str] = ("entry", "speaker"), semi: bool = True) -> DataFrame:
    """Outliers whose block's end is another block's start or end in the same entry, that block having another interval and another text (semi), or the others (anti).

    The disjunction becomes two equi keys, so the join is hashed.
    """
    at = outliers.join(blocks.select(*keys, "block_index", F.col("start_ms").alias("s_"), F.col("end_ms").alias("e_"), F.col("text").alias("t_")), [*keys, "block_index"], "left")
    spots = others.select(F.col("entry").alias("entry_o"), F.explode(F.array_distinct(F.array("start_ms", "end_ms"))).alias("spot"), F.col("start_ms").alias("s_o"), F.col("end_ms").alias("e_o"), F.col("text").alias("t_o"))
    on = (F.col("entry") == F.col("entry_o")) & (F.col("e_") == F.col("spot")) & ~((F.col("s_o") == F.col("s_")) & (F.col("e_o") == F.col("e_"))) & (F.col("t_o") != F.col("t_"))
    return at.join(spots, on, "left_semi" if semi else "left_anti").drop("s_", "e_", "t_")


def zero_fill_grid(counts: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every value of ``row`` with every value of ``column`` (both few and distinct), 0 where there is no count."""
    grid = counts.select(row).distinct().crossJoin(broadcast_if_small(counts.select(column).distinct(), F.lit(32)))
    return grid.join(counts, [row, column], "left").fillna(0, [value])


def variants(number: int, count: int = 10, size: int = 6) -> Column:
    """Rows (variant, batch) for a number: v1..v<count>, in batches of ``size``."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda v: F.struct(v.alias("variant"), (F.floor((v - 1) / size) + 1).alias("batch")))


#: Rows that a range of a global order should hold, and ranges at most: beyond a billion rows ranges grow, and Spark sorts them with spilling.
RANGE_ROWS, MOST_RANGES = 20_000, 50_000


def running(df: DataFrame, value: Column, order: Sequence[str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``out``: the sum of ``value`` (whole numbers) over all rows before, by ``order``, in all or within ``keys``. See ``running_all``."""
    return running_all(df, {out: (value, F.sum)}, order, keys)


def running_all(df: DataFrame, values: dict[str, tuple[Column, Callable[[Column], Column]]], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """For each name a whole number, combined (by ``F.sum`` or ``F.bit_xor``; 0 if there are none) over all rows before, in all or within ``keys``.

    ``order`` are columns without nulls; rows that tie in all of them must be
    equal. Spark cuts the rows into ranges of the order and writes them with
    their range's number, so that neither a global order nor a hot key is one
    task, however many rows there are: the ranges' totals are combined first,
    then each range by itself.
    """
    wanted = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    if wanted < 2:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # RANGE_ROWS rows at most
        return df.withColumns({out: F.coalesce(f(v.cast("long")).over(w), F.lit(0).cast("long")) for out, (v, f) in values.items()})
    ranged = materialize(df.repartitionByRange(wanted, *[k for k in keys if k not in order], *order).withColumn("range_", F.spark_partition_id()))
    named = {f"value_{i}_": v.cast("long") for i, (v, _) in enumerate(values.values())}
    ranged = ranged.withColumns(named)
    names, zero = [*keys, "range_"], F.lit(0).cast("long")
    totals = ranged.groupBy(*names).agg(*(f(c).alias(c) for c, (_, f) in zip(named, values.values(), strict=True)))  # a row for each range (and key)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(k).alias(f"{k}_b") for k in names), *(F.coalesce(f(c).over(w), zero).alias(f"{c}b") for c, (_, f) in zip(named, values.values(), strict=True)))
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    inner = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = lambda f, a, b: a.bitwiseXOR(b) if f is F.bit_xor else a + b
    summed = ranged.join(base if keys else F.broadcast(base), on)  # without keys a row for each range
    summed = summed.withColumns({out: both(f, F.col(f"{c}b"), F.coalesce(f(c).over(inner), zero)) for c, (out, (_, f)) in zip(named, values.items(), strict=True)})
    return summed.drop("range_", *named, *(f"{c}b" for c in named), *(f"{k}_b" for k in names))
