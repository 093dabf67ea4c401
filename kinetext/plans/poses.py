"""From keypoints to a dictionary, and from a list of glosses to one stitched pose sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import matching, motion


def dictionary(marked: DataFrame, cameras: DataFrame, wanted: DataFrame, drop_shared: bool = False) -> DataFrame:
    """Marked blocks and cameras to gloss -> best sequence."""
    items = D.pose_sequences(D.intervals_in_frames(marked), D.frames(cameras), drop_shared=drop_shared)
    items = items.where(F.size("pose_sequence") > 0).withColumnRenamed("text", "gloss")
    # Ties in confidence go to the first seen: the smallest (entry, speaker, pos).
    return D.build_dictionary(items, wanted)


def translate(queries: DataFrame, glosses: DataFrame, poses: DataFrame, times: DataFrame | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """Lists of words (query, pos, q) to one pose sequence per query: match, look up, scale to the first, stretch, stitch."""
    matched = matching.cascade(queries, glosses, nearest).where("match is not null").select("query", "pos", F.col("match").alias("gloss"))
    found = motion.scale_to_first(motion.lookup(matched, poses))
    if times is not None:
        found = motion.fill_durations(found, times)
    return motion.stitch(found, times)


def frame_counts(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("n_frames", F.size("pose_sequence"))


