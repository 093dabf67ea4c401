"""From keypoint recordings to a dictionary of the best pose sequence per gloss, and audits of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keypoints as K
from ..functions import text as X
from ..schemas import KEYPOINT_KEYS, RAW_SIZES, STORED_SIZES
from .intervals import frames_in_intervals
from .joins import broadcast_if_small


def frames(cameras: DataFrame, skip: Sequence[str] = ("c",)) -> DataFrame:
    """One row per (entry, camera, frame, person): the arrays normalised by the camera's size, the body cut to its upper part.

    ``cameras`` has entry, camera_no and the camera struct; the camera at
    position 0 is speaker A, at 1 speaker B.
    """
    c = F.col("cam")
    return people(cameras.select("entry", "camera_no", c["camera"].alias("camera"), c["width"].alias("width"), c["height"].alias("height"), F.explode(c["frames"]).alias("frame", "body")), skip)


def people(frames: DataFrame, skip: Sequence[str] = ("c",)) -> DataFrame:
    """``frames`` of what has a row for each frame already: entry, camera_no, camera, width, height, frame and body."""
    named = F.when(F.col("camera_no") == 0, "A").when(F.col("camera_no") == 1, "B")
    rows = frames.where(~F.coalesce(F.col("camera").isin(*skip), F.lit(False))).select("entry", "camera_no", named.alias("speaker"), F.col("width").alias("w"), F.col("height").alias("h"), "frame", "body")
    rows = rows.select("entry", "camera_no", "speaker", "w", "h", F.col("frame").cast("int").alias("frame"), F.posexplode("body.people").alias("person_no", "p"))
    norm = lambda k: K.normalize(F.col("p")[k], F.col("w"), F.col("h"))
    person = F.struct(K.select_points(norm("pose_keypoints_2d")).alias("pose_keypoints_2d"), *(norm(k).alias(k) for k in KEYPOINT_KEYS[1:]))
    return rows.select("entry", "camera_no", "speaker", "frame", "person_no", person.alias("person"))


def intervals_in_frames(blocks: DataFrame, fps: Column | float = 50) -> DataFrame:
    """Gloss blocks with first_frame and last_frame; sentences left out."""
    return blocks.where(~F.col("is_full")).withColumns({"first_frame": X.ms_to_frame("start_ms", fps), "last_frame": X.ms_to_frame("end_ms", fps)})


def pose_sequences(intervals: DataFrame, people: DataFrame, keys: Sequence[str] = ("entry", "speaker", "pos", "text"), drop_shared: bool = False) -> DataFrame:
    """``pose_sequence`` of each interval: all people of its frames, in order; empty where no frame is there.

    With ``drop_shared``, people of frames that several intervals cover are left out.
    """
    hits = frames_in_intervals(intervals.select(*keys, "first_frame", "last_frame"), people, ["entry", "speaker"], "first_frame", "last_frame", "frame", keys)
    if drop_shared:
        shared = Window.partitionBy("entry", "speaker", "frame", "person_no")
        hits = hits.withColumn("n_", F.count(F.lit(1)).over(shared)).withColumn("person", F.when(F.col("n_") == 1, F.col("person")))
    item = F.when(F.col("person").isNotNull(), F.struct("frame", "person_no", "person"))
    return hits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["person"]).alias("pose_sequence"))  # a gloss has about a hundred frames at most


def best_per_key(items: DataFrame, key: str, score: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The row with the highest score per key, the first in ``order`` (columns of any types, together without ties) among equal scores.

    Only scores and orders are compared, in two narrow aggregates; payloads join the winners. Rows without a score are left out.
    """
    slim = items.select(key, score, *order).where(F.col(score).isNotNull())
    top = slim.groupBy(key).agg(F.max(score).alias("top_"))
    first = slim.join(top, key).where(F.col(score) == F.col("top_")).groupBy(key).agg(F.min(F.struct(*order)).alias("first_")).select(key, *(F.col(f"first_.{c}").alias(c) for c in order))
    return items.select(key, *order, score, *payload).join(first, [key, *order])


def build_dictionary(items: DataFrame, wanted: DataFrame, order: Sequence[str] = ("entry", "speaker", "pos"), sizes: tuple[int, ...] = STORED_SIZES) -> DataFrame:
    """gloss -> the sound sequence with the best mean confidence; only wanted glosses."""
    sound = items.where(~K.is_corrupt("pose_sequence", sizes)).withColumn("avg_conf", K.mean_confidence("pose_sequence"))
    wanted = broadcast_if_small(wanted.select("gloss").distinct(), F.length("gloss"))
    return best_per_key(sound.join(wanted, "gloss", "left_semi"), "gloss", "avg_conf", order, ["pose_sequence"])


def missing_glosses(wanted: DataFrame, dictionary: DataFrame) -> DataFrame:
    return wanted.select("gloss").distinct().join(dictionary.select("gloss"), "gloss", "left_anti")


def size_audit(people: DataFrame, person: str = "person", sizes: Sequence[int] = RAW_SIZES, keys: Sequence[str] = ("entry", "camera", "frame")) -> DataFrame:
    """Rows (keys, part, expected, actual) of arrays of a wrong size; a missing array has size 0."""
    parts = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(n).alias("expected"), F.greatest(F.coalesce(F.size(F.col(person)[k]), F.lit(0)), F.lit(0)).alias("actual")) for k, n in zip(KEYPOINT_KEYS, sizes, strict=True)))
    return people.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*").where(F.col("expected") != F.col("actual"))


def size_audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entry", "frame").alias("frames"))


def dictionary_audit(dictionary: DataFrame, sizes: Sequence[int] = STORED_SIZES) -> DataFrame:
    """Distinct (gloss, part, expected, actual) of a dictionary's defects."""
    return size_audit(dictionary.select("gloss", F.explode("pose_sequence").alias("person")), "person", sizes, ["gloss"]).distinct()


def camera_sizes(cameras: DataFrame) -> DataFrame:
    """How many files have each (width, height)."""
    pairs = cameras.select("entry", F.col("cam.width").alias("width"), F.col("cam.height").alias("height")).distinct()
    return pairs.groupBy("width", "height").agg(F.count(F.lit(1)).alias("files"))


def files_with_several_sizes(cameras: DataFrame) -> DataFrame:
    pairs = cameras.select("entry", F.struct(F.col("cam.width").alias("width"), F.col("cam.height").alias("height")).alias("size"))
    return pairs.groupBy("entry").agg(F.array_sort(F.collect_set("size")).alias("sizes")).where(F.size("sizes") > 1)


def needs_stretching(lengths: DataFrame, times: DataFrame, ms_per_frame: int = 20) -> DataFrame:
    """Counts of sequences that are shorter than their gloss's median duration: rows gloss, n_frames with times gloss, median_gd."""
    both = lengths.join(times.select("gloss", "median_gd"), "gloss", "left")
    short = F.col("n_frames") * ms_per_frame < F.col("median_gd")
    out = both.agg(F.count_if(short).alias("needs"), F.count_if(F.col("median_gd").isNull()).alias("skipped"), F.count("median_gd").alias("checked"))
    return out.withColumn("percent", F.try_divide(F.col("needs") * 100.0, F.col("checked")))


def corpus_totals(files: DataFrame, glosses: DataFrame) -> DataFrame:
    """Bytes and frames of files, and all and different glosses."""
    a = files.agg(F.sum("size").alias("bytes"), F.sum("frames").alias("frames"))
    b = glosses.agg(F.count(F.lit(1)).alias("glosses"), F.countDistinct("gloss").alias("unique_glosses"))
    return a.crossJoin(b).withColumn("gib", X.gib("bytes"))


def missing_links(rows: DataFrame, first: str, second: str) -> DataFrame:
    """How many rows lack one link, the other, both, and either."""
    a, b = F.col(first).isNull(), F.col(second).isNull()
    return rows.agg(F.count_if(a).alias(f"no_{first}"), F.count_if(b).alias(f"no_{second}"), F.count_if(a & b).alias("neither"), F.count_if(a | b).alias("incomplete"))


def prefix_counts(rows: DataFrame, glosses: str, targets: Sequence[str]) -> DataFrame:
    """Rows whose first gloss starts with a target, and rows of which any does, per target and for all."""
    first = F.get(F.split(glosses, ","), F.lit(0))
    every = F.split(glosses, ",")

    def any_starts(t: str) -> Column:
        return F.exists(every, lambda g: g.startswith(t))

    cols = []
    for i, t in enumerate(targets):
        cols += [F.count_if(first.startswith(t)).alias(f"first_{i}"), F.count_if(any_starts(t)).alias(f"any_{i}")]
    hit = F.lit(False)
    for t in targets:
        hit = hit | any_starts(t)
    return rows.agg(*cols, F.count_if(hit).alias("any"))
