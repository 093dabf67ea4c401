"""Timing of glosses: durations, gaps into and out of a gloss, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments as S
from .joins import broadcast_if_small

METRICS = ("gd", "igt", "ogt", "tgt")


def gloss_times(blocks: DataFrame, keys: Sequence[str] = S.KEYS, order: str = "pos", types: DataFrame | None = None) -> DataFrame:
    """gd, igt, ogt, tgt (ms) of each gloss occurrence, with the blocks they were measured between.

    Glosses of one sentence with equal intervals are one group. A group's igt
    is its distance from the end of the group before, its ogt that to the next
    one's start; neither is negative, and a group with the sentence's end has
    no ogt. Lost glosses and a sentence's only gloss have a duration only.
    ``types`` restricts what is reported, not what gaps are measured to.
    """
    flagged = S.lost_flags(blocks, keys, order).where(~F.col("is_full") | F.col("is_end"))
    flagged = flagged.withColumn("gd", F.col("end_ms") - F.col("start_ms"))
    part = [*keys, "sid", "lost"]
    main = Window.partitionBy(*part)
    n_main = F.count(F.lit(1)).over(main)
    spot = [*part, "start_ms", "end_ms"]
    groups = flagged.where(~F.col("lost")).groupBy(*spot).agg(F.min(order).alias("first"), F.min_by("block_index", order).alias("at"), F.max("is_end").alias("has_end"))
    w = Window.partitionBy(*part).orderBy("start_ms", "first")
    last_group = F.lead("start_ms").over(w).isNull()
    no_ogt = F.col("has_end") | last_group
    zero = F.lit(0).cast("long")
    groups = groups.withColumns({
        "igt": F.coalesce(F.greatest(zero, F.col("start_ms") - F.lag("end_ms").over(w)), zero),
        "ogt": F.when(no_ogt, zero).otherwise(F.greatest(zero, F.lead("start_ms").over(w) - F.col("end_ms"))),
        "prev_at": F.lag("at").over(w),
        "next_at": F.when(~no_ogt, F.lead("at").over(w)),
    })
    out = flagged.withColumn("n_main", n_main).join(groups.drop("first", "has_end"), spot, "left")
    alone = F.col("lost") | (F.col("n_main") == 1)
    into, beyond = F.concat("prev_at", F.lit("-"), "at"), F.concat("at", F.lit("-"), "next_at")
    index = F.col("block_index")
    both = F.when(F.col("prev_at").isNull() & F.col("next_at").isNull(), F.col("at")).otherwise(
        F.concat(F.lit("IGT:"), F.coalesce(into, F.lit("None")), F.lit(" | OGT:"), F.coalesce(beyond, F.lit("None")))
    )
    out = out.select(
        *keys, order, "block_index", "gloss", "gd",
        F.when(alone, zero).otherwise(F.col("igt")).alias("igt"), F.when(alone, zero).otherwise(F.col("ogt")).alias("ogt"),
        F.when(alone, index).otherwise(F.coalesce(F.concat(F.lit("index:"), into), F.lit("None"))).alias("igt_index"),
        F.when(alone, index).otherwise(F.coalesce(F.concat(F.lit("index:"), beyond), F.lit("None"))).alias("ogt_index"),
        F.when(alone, index).otherwise(both).alias("tgt_index"), "lost",
    )
    out = out.withColumn("tgt", F.col("igt") + F.col("gd") + F.col("ogt"))
    return out.join(broadcast_if_small(types.distinct(), F.length("gloss")), "gloss", "left_semi") if types is not None else out


def summaries(df: DataFrame, by: Sequence[str], metrics: Sequence[str], shares: Sequence[float] = (), rows: bool = False) -> DataFrame:
    """by, metric, n, mean, std (of a sample) and p, exact interpolated percentiles in the order of ``shares``, for each metric of each group that has values.

    Equal values are counted first, and what follows works on these counts:
    the rows are read once, and no task has all values of a group. The counts
    of an eighth of an octave say in which of them the wanted ranks lie; only
    the values there are sorted. With ``rows`` a metric named '' counts the
    rows.
    """
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics] + [F.struct(F.lit("").alias("metric"), F.lit(0.0).alias("v"))] * rows
    counts = df.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*").where("v is not null").groupBy(*by, "metric", "v").agg(F.count(F.lit(1)).alias("c"))
    octave = F.floor(F.log2(F.abs("v")) * 8).cast("long") + 100_000
    counts = counts.withColumn("cell", F.when(F.col("v") > 0, octave).when(F.col("v") < 0, -octave).otherwise(0))
    group = [*by, "metric"]
    w = Window.partitionBy(*group)
    totals = counts.groupBy(*group, "cell").agg(F.sum("c").alias("held"), F.sum(F.col("c") * F.col("v")).alias("total"))

    def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        """An equi join in which null keys meet."""
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
        return left.join(right.withColumnsRenamed({k: f"{k}_r" for k in keys}), on).drop(*(f"{k}_r" for k in keys))

    means = totals.groupBy(*group).agg(F.sum("held").alias("n"), (F.sum("total") / F.sum("held")).alias("mean"))
    moments = joined(counts.drop("cell"), means, group).groupBy(*group).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("m2"))
    moments = moments.withColumn("std", F.sqrt(F.try_divide("m2", F.col("n") - 1))).drop("m2")
    if not shares:
        return moments.withColumn("p", F.array().cast("array<double>"))
    totals = totals.withColumns({"n": F.sum("held").over(w), "first": F.sum("held").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")})
    rank = lambda p, f: f(F.col("n").cast("double") * p - p)
    ranks = [rank(p, f) for p in shares for f in (F.floor, F.ceil)]
    here = lambda r, start, size: (r >= start) & (r < start + size)
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | here(r, F.col("first"), F.col("held"))
    values = joined(counts, totals.where(wanted).select(*group, "cell", "n", "first"), [*group, "cell"])
    inside = Window.partitionBy(*group, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("start", F.col("first") + F.sum("c").over(inside) - F.col("c"))
    picked = values.groupBy(*group).agg(F.max("n").alias("n"), *(F.max(F.when(here(r, F.col("start"), F.col("c")), F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)))
    between = [F.col(f"r{2 * i}") + (F.col(f"r{2 * i + 1}") - F.col(f"r{2 * i}")) * (F.col("n").cast("double") * p - p - rank(p, F.floor)) for i, p in enumerate(shares)]
    return joined(moments, picked.select(*group, F.array(*between).alias("p")), group)


def statistics(df: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS, count: str = "count") -> DataFrame:
    """Mean, median and sample deviation of each metric, and the count, per group."""
    of = lambda m, x: F.max(F.when(F.col("metric") == m, x))
    cells = [of(m, x).alias(f"{name}_{m}") for m in metrics for name, x in (("avg", F.col("mean")), ("median", F.col("p")[0]), ("std", F.col("std")))]
    return summaries(df, by, metrics, [0.5], rows=True).groupBy(*by).agg(*cells, of("", F.col("n")).alias(count))


def global_statistics(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric: mean, median, std, q25, q75."""
    found = summaries(df, [], metrics, [0.5, 0.25, 0.75])
    return found.select("metric", "mean", F.col("p")[0].alias("median"), "std", F.col("p")[1].alias("q25"), F.col("p")[2].alias("q75"))


def with_group_statistics(df: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Each row with its group's means and medians: the aggregate, which is small, joined back, so that no group is gathered."""
    groups = statistics(df, by, metrics).select(*by, *(f"{name}_{m}" for m in metrics for name in ("avg", "median")))
    return df.join(groups, list(by), "left")


def threshold(df: DataFrame, metric: str, limit: float, above: bool = True, columns: Sequence[str] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows over (or under) a limit, the largest first."""
    c = F.col(metric)
    out = df.where(c > limit if above else c < limit).orderBy(F.desc(metric), *ties)
    return out.select(*columns) if columns else out


def extremes(df: DataFrame, metric: str, n: int = 10, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(metric) if largest else F.asc(metric), *ties).limit(n)


def to_frames(ms: Column | str, fps: int = 50) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return c * fps / 1000


def fill_times(glosses: DataFrame, times: DataFrame, columns: Sequence[str] = ("median_igt", "median_ogt", "median_gd")) -> DataFrame:
    """Glosses with their timing columns; 0 where there is none."""
    return glosses.join(times.select("gloss", *columns), "gloss", "left").fillna(0.0, list(columns))


def clean_times(raw: DataFrame, columns: Sequence[str] = ("median_igt", "median_ogt", "median_gd")) -> DataFrame:
    """Text columns as numbers; one that is no number makes all three 0."""
    cast = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}
    bad = F.greatest(*(cast[c].isNull() for c in columns))
    return raw.select("gloss", *(F.when(bad, 0.0).otherwise(cast[c]).alias(c) for c in columns))
