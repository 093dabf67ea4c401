"""Joins on intervals of any lengths, through an index over several levels.

Level l has cells of 2^l units. An interval is filed at the level of its own
length, where it touches two cells or three at most, however long it is. A point
looks up one cell a level, an interval the cells that it touches at its own
level and those above. So each side makes at most a few rows a level that
occurs, and a pair is found once. Each join is an equi join with plain
exchanges on both sides: a crowded cell can be split while the join runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(start: Column, end: Column, unit: float = 1.0) -> Column:
    """The smallest level whose cells are as long as the interval; shorter ones than ``unit`` count as that long."""
    return F.ceil(F.log2(F.greatest((end - start).cast("double"), F.lit(float(unit))))).cast("int")


def cell(x: Column, at: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), at)).cast("long")


def cells(start: Column, end: Column, at: Column) -> Column:
    """The cells of a level that [start, end] touches; an interval that ends before it starts is filed at its start."""
    return F.sequence(cell(start, at), cell(F.greatest(start, end), at))


def levels(df: DataFrame, start: str, end: str, unit: float = 1.0) -> list[int]:
    """The levels that occur: one for each doubling of the length."""
    return sorted(r[0] for r in df.select(level(F.col(start), F.col(end), unit).alias("l")).distinct().collect() if r[0] is not None)


def _on(keys: Sequence[str], *more: Column) -> Column:
    on = (F.col("level_") == F.col("level_r")) & (F.col("cell_") == F.col("cell_r"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_r"))
    for c in more:
        on = on & c
    return on


def _filed(df: DataFrame, start: str, end: str, unit: float) -> DataFrame:
    own = df.withColumn("level_", level(F.col(start), F.col(end), unit))
    return own.withColumn("cell_", F.explode(cells(F.col(start), F.col(end), F.col("level_"))))


def _other(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_r" for k in keys} | {"level_": "level_r", "cell_": "cell_r"})


def _dropped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.drop("level_", "cell_", "level_r", "cell_r", *(f"{k}_r" for k in keys))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, closed: bool = True, unit: float = 1.0) -> DataFrame:
    """Pairs with equal keys and start <= point <= end (or < end). Nulls match nothing. The columns of both sides but for the intervals' keys."""
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end))
    here = F.array(*(F.struct(F.lit(n).alias("level_"), cell(F.col(point), F.lit(n)).alias("cell_")) for n in levels(intervals, start, end, unit)))
    asked = points.withColumn("spot_", F.explode(here.cast("array<struct<level_:int,cell_:bigint>>"))).select("*", "spot_.level_", "spot_.cell_").drop("spot_")
    return _dropped(asked.join(_other(_filed(intervals, start, end, unit), keys), _on(keys, inside)), keys)


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], unit: float = 1.0) -> DataFrame:
    """Pairs of half-open intervals with equal keys, b.start < a.end and b.end > a.start. Nulls match nothing.

    Of a pair the longer one is filed and the shorter one looks it up, on the
    left where both have one level. Both touch the cell where the later one
    starts, and only there the pair is kept.
    """

    def asking(df: DataFrame, ends: tuple[str, str], above: list[int], same: bool) -> DataFrame:
        s, e = F.col(ends[0]), F.col(ends[1])
        own = level(s, e, unit)
        wanted = F.filter(F.array(*map(F.lit, above)).cast("array<int>"), lambda n: (n >= own) if same else (n > own))
        return df.withColumn("level_", F.explode(wanted)).withColumn("cell_", F.explode(cells(s, e, F.col("level_"))))

    meet = (F.col(b[0]) < F.col(a[1])) & (F.col(b[1]) > F.col(a[0]))
    once = F.col("cell_") == cell(F.greatest(F.col(a[0]), F.col(b[0])), F.col("level_"))
    long_left = _filed(left, *a, unit).join(_other(asking(right, b, levels(left, *a, unit), True), keys), _on(keys, meet, once))
    long_right = asking(left, a, levels(right, *b, unit), False).join(_other(_filed(right, *b, unit), keys), _on(keys, meet, once))
    return _dropped(long_left, keys).unionByName(_dropped(long_right, keys))


def frames_in_intervals(intervals: DataFrame, frames: DataFrame, keys: Sequence[str], first: str, last: str, frame: str, ids: Sequence[str] | None = None) -> DataFrame:
    """Each interval with the rows of its frames, ``first <= frame <= last``.

    Frame numbers alone go through the index; what else a frame's rows have is
    joined to the pairs afterwards, so it moves once. With ``ids`` (columns of
    the intervals that tell them apart) an interval without frames stays, with
    nulls.
    """
    numbers = frames.select(*keys, frame).distinct()
    found = points_in_intervals(numbers, intervals, keys, frame, first, last)
    hits = found.join(frames, [*keys, frame])
    if ids is None:
        return hits
    more = [c for c in hits.columns if c not in intervals.columns]
    back = hits.select(*(F.col(c).alias(f"{c}_h") for c in ids), *more)
    on = F.lit(True)
    for c in ids:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_h"))
    return intervals.join(back, on, "left").select(*intervals.columns, *more)


def snap_to_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], id_cols: Sequence[str], point: str, start: str, end: str, order: Sequence[str], unit: float = 1.0) -> DataFrame:
    """The start of the first interval (in ``order``) that holds the point, else the point, as ``snapped``."""
    found = points_in_intervals(points, intervals, keys, point, start, end, closed=False, unit=unit)
    first = found.groupBy(*id_cols).agg(F.min_by(start, F.struct(*order)).alias("snapped_"))
    return points.join(first, list(id_cols), "left").withColumn("snapped", F.coalesce("snapped_", point)).drop("snapped_")
