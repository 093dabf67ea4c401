"""Pose sequences in motion: scaling to a reference, stretching, stitching, smoothness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import keypoints as K
from ..functions import text as X
from .joins import broadcast_if_small
from .timing import summaries

DEFAULT_GAP = 7


def _dims(prefix: str) -> dict[str, Column]:
    return {f: F.col(f"{prefix}.{f}") for f in ("neck", "shoulder", "torso", "face_w", "face_h")}


def scale_to_first(sequences: DataFrame, keys: Sequence[str] = ("query",), order: str = "pos", uniform: bool = True) -> DataFrame:
    """Every later sequence of a query scaled to the body of the first; one without shoulders or torso stays as it is."""
    own = sequences.withColumn("own_", K.reference_dims(F.get("pose_sequence", F.lit(0))))
    # Only the first sequence's five lengths travel; they join its query's other sequences, however many there are.
    first = own.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at_"), F.col("own_").alias("ref_"))).alias("first_")).select(*keys, "first_.at_", "first_.ref_")
    own = own.join(broadcast_if_small(first, F.lit(64)), list(keys))
    r, o = _dims("ref_"), _dims("own_")
    sx, sy = r["shoulder"] / F.nullif(o["shoulder"], F.lit(0.0)), r["torso"] / F.nullif(o["torso"], F.lit(0.0))
    boxed = (o["face_w"] > 0) & (o["face_h"] > 0)
    fx, fy = F.when(boxed, F.try_divide(r["face_w"], o["face_w"])), F.when(boxed, F.try_divide(r["face_h"], o["face_h"]))
    if uniform:
        sx = sy = (sx + sy) / 2
        fx = fy = (fx + fy) / 2
    own = own.withColumns({"sx_": sx, "sy_": sy, "fx_": fx, "fy_": fy, "neck_": r["neck"]})
    scaled = F.transform("pose_sequence", lambda f: K.scale_frame(f, F.col("sx_"), F.col("sy_"), F.col("fx_"), F.col("fy_"), F.col("neck_")))
    keep = (F.col(order) == F.col("at_")) | F.col("sx_").isNull() | F.col("sy_").isNull()
    return own.withColumn("pose_sequence", F.when(keep, F.col("pose_sequence")).otherwise(scaled)).drop("own_", "ref_", "at_", "sx_", "sy_", "fx_", "fy_", "neck_")


def lookup(queries: DataFrame, dictionary: DataFrame, keys: Sequence[str] = ("query",)) -> DataFrame:
    """The sequences of a list of glosses in their order; glosses that the dictionary lacks are left out and the rest renumbered."""
    found = queries.join(dictionary.select("gloss", "pose_sequence"), "gloss")
    return found.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))


def fill_durations(sequences: DataFrame, times: DataFrame, fps: int = 50, blender=K.between_frames) -> DataFrame:
    """Each sequence stretched to its gloss's median duration; those without one stay."""
    both = sequences.join(times.select("gloss", "median_gd"), "gloss", "left")
    return both.withColumn("pose_sequence", K.stretch("pose_sequence", X.ms_to_frames_rounded("median_gd", fps), blender)).drop("median_gd")


def gap_frames(prev_ogt: Column, cur_igt: Column, fps: int = 50, default: int = DEFAULT_GAP) -> Column:
    """Frames between two glosses: the mean of the way out and the way in, rounded to ms and then to frames, halves to even; the default if unknown or under one."""
    ms = F.bround((prev_ogt + cur_igt) / 2)
    n = F.bround(ms / 1000.0 * fps).cast("int")
    return F.when(n >= 1, n).otherwise(default)


def stitch(sequences: DataFrame, times: DataFrame | None = None, keys: Sequence[str] = ("query",), fps: int = 50, default: int = DEFAULT_GAP, blender=K.between_frames) -> DataFrame:
    """One sequence per query: its sequences in order with blended frames between neighbours."""
    w = Window.partitionBy(*keys).orderBy("pos")
    if times is not None:
        sequences = sequences.join(times.select("gloss", "median_igt", "median_ogt"), "gloss", "left")
        n = gap_frames(F.lag("median_ogt").over(w), F.col("median_igt"), fps, default)
    else:
        n = F.lit(default)
    rows = sequences.withColumns({"n_": n, "last_": F.lag(F.element_at("pose_sequence", -1)).over(w)})
    gap = F.when(F.col("last_").isNotNull(), blender(F.col("last_"), F.get("pose_sequence", F.lit(0)), F.col("n_")))
    part = F.when(gap.isNotNull(), F.concat(gap, "pose_sequence")).otherwise(F.col("pose_sequence"))
    rows = rows.select(*keys, F.struct("pos", part.alias("frames")).alias("part"))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["frames"])).alias("pose_sequence"))


def mean_squared_jerk(frames: DataFrame, keys: Sequence[str], order: str, positions: str) -> DataFrame:
    """Mean squared norm of the third difference of positions; null under four frames."""
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = frames.select(*keys, F.col(positions).alias("x0"), *(F.lag(positions, k).over(w).alias(f"x{k}") for k in (1, 2, 3)))
    jerk = F.zip_with(F.zip_with("x0", "x3", lambda a, d: a - d), F.zip_with("x2", "x1", lambda c, b: (c - b) * 3), lambda p, q: p + q)
    square = F.aggregate(jerk, F.lit(0.0), lambda s, v: s + v * v)
    return lagged.groupBy(*keys).agg(F.avg(F.when(F.col("x3").isNotNull(), square)).alias("msj"))


@F.pandas_udf(DoubleType())
def _arc_length(speeds: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spectral arc length of a series of speeds; there is no FFT among Spark's functions."""

    def one(s) -> float | None:
        if s is None or len(s) < 1:
            return None
        m = len(s)
        size = np.abs(np.fft.fft(np.asarray(s, float)))[: m // 2 + 1]
        freq = np.fft.fftfreq(m)[: m // 2 + 1]
        whole = size.sum()
        reach = np.flatnonzero(np.cumsum(size) / whole >= 0.99) if whole > 0 else []
        cut = int(reach[0]) if len(reach) else len(freq) - 1
        step = freq[1] - freq[0] if len(freq) > 1 else 1.0
        return -float(np.sqrt(np.diff(size[: cut + 1]) ** 2 + step**2).sum()) if cut > 0 else -0.0

    for part in speeds:
        yield part.map(one)


def speeds(frames: DataFrame, keys: Sequence[str], order: str, positions: str) -> DataFrame:
    """The norms of the first differences of positions, in order, as an array per sequence."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.zip_with(positions, F.lag(positions).over(w), lambda a, b: (a - b) * (a - b))
    rows = frames.select(*keys, F.col(order).alias("o"), F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, v: s + v)).alias("v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("o", "v")))), lambda x: x["v"]).alias("speeds"))


def spectral_arc_length(frames: DataFrame, keys: Sequence[str], order: str, positions: str) -> DataFrame:
    return speeds(frames, keys, order, positions).select(*keys, _arc_length("speeds").alias("sal"))


def smoothness(frames: DataFrame, keys: Sequence[str], order: str, positions: str) -> DataFrame:
    """sal and msj of sequences that have both."""
    both = spectral_arc_length(frames, keys, order, positions).join(mean_squared_jerk(frames, keys, order, positions), list(keys))
    return both.where("sal is not null and msj is not null")


def smoothness_table(scores: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Mean, median and deviation of sal and msj, side by side for each label, to four places."""
    shown = lambda c: F.format_number(c, 4)
    found = summaries(scores.where(F.col(label).isin(list(labels))), [label], ["sal", "msj"], [0.5])  # a row for each label and metric
    of = lambda x, m, c: F.max(F.when((F.col(label) == x) & (F.col("metric") == m), shown(c)))
    cells = [of(x, m, c).alias(f"{x}_{name}_{m}") for x in labels for m in ("sal", "msj") for name, c in (("mean", F.col("mean")), ("median", F.col("p")[0]), ("std", F.col("std")))]
    return found.groupBy(F.lit(1).alias("row_")).agg(*cells).drop("row_")
