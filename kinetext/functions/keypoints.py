"""Functions on flat keypoint arrays (x, y, confidence triples), as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KEYPOINT_KEYS, STORED_SIZES

# Keypoints of the upper body that a stored frame keeps, and where the anchor points stand in it.
UPPER_BODY = (0, 1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 17, 18)
NOSE, NECK, RIGHT_SHOULDER, LEFT_SHOULDER, HIP, NOSE_TIP = 0, 1, 2, 5, 8, 30


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(arr: Column | str, width: Column, height: Column) -> Column:
    """x over width, y over height; a missing size counts as 1."""
    w, h = F.coalesce(width, F.lit(1)), F.coalesce(height, F.lit(1))
    return F.transform(col(arr), lambda v, i: F.when(i % 3 == 0, v / w).when(i % 3 == 1, v / h).otherwise(v))


def select_points(arr: Column | str, points: tuple[int, ...] = UPPER_BODY) -> Column:
    return F.flatten(F.transform(F.array(*(F.lit(p) for p in points)), lambda p: F.slice(col(arr), p * 3 + 1, 3)))


def restore_points(arr: Column | str, points: tuple[int, ...] = UPPER_BODY, total: int = 25) -> Column:
    """The inverse of select_points, with zeros for the points that were left out."""
    zero = F.array(*(F.lit(0.0),) * 3)
    return F.concat(*(F.slice(col(arr), points.index(p) * 3 + 1, 3) if p in points else zero for p in range(total)))


def strided(arr: Column | str, k: int) -> Column:
    """Every third value from the k-th: 0 x, 1 y, 2 confidence."""
    return F.filter(col(arr), lambda v, i: i % 3 == k)


def box(arr: Column | str) -> tuple[Column, Column]:
    """Width and height of the bounding box; 0 without points."""
    side = lambda k: F.coalesce(F.array_max(strided(arr, k)) - F.array_min(strided(arr, k)), F.lit(0.0))
    return side(0), side(1)


def at(arr: Column | str, point: int, k: int) -> Column:
    return F.get(col(arr), F.lit(point * 3 + k))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def between(arr: Column | str, a: int, b: int) -> Column:
    return distance(at(arr, a, 0), at(arr, a, 1), at(arr, b, 0), at(arr, b, 1))


def reference_dims(frame: Column) -> Column:
    """Neck, shoulder and torso lengths and the face box of a frame."""
    pose = frame["pose_keypoints_2d"]
    w, h = box(frame["face_keypoints_2d"])
    return F.struct(between(pose, NECK, NOSE).alias("neck"), between(pose, RIGHT_SHOULDER, LEFT_SHOULDER).alias("shoulder"), between(pose, NOSE, HIP).alias("torso"), w.alias("face_w"), h.alias("face_h"))


def scale(arr: Column | str, sx: Column, sy: Column) -> Column:
    return F.transform(col(arr), lambda v, i: F.when(i % 3 == 0, v * sx).when(i % 3 == 1, v * sy).otherwise(v))


def fix_neck(pose: Column | str, length: Column) -> Column:
    """The nose moved along the line from the neck to that length; unchanged if it stands on the neck."""
    pose = col(pose)
    now = between(pose, NECK, NOSE)
    moved = lambda k: at(pose, NECK, k) + (at(pose, NOSE, k) - at(pose, NECK, k)) * (length / now)
    return F.when(now > 0, F.transform(pose, lambda v, i: F.when(i == 0, moved(0)).when(i == 1, moved(1)).otherwise(v))).otherwise(pose)


def place_face(face: Column | str, nose_x: Column, nose_y: Column, sx: Column, sy: Column) -> Column:
    """The face scaled about its nose tip, which moves to the nose; unchanged without a nose tip or a scale."""
    face = col(face)
    moved = F.transform(face, lambda v, i: F.when(i % 3 == 0, nose_x + (v - at(face, NOSE_TIP, 0)) * sx).when(i % 3 == 1, nose_y + (v - at(face, NOSE_TIP, 1)) * sy).otherwise(v))
    return F.when((F.size(face) >= 3 * (NOSE_TIP + 1)) & sx.isNotNull(), moved).otherwise(face)


def scale_frame(frame: Column, sx: Column, sy: Column, face_sx: Column, face_sy: Column, neck: Column) -> Column:
    """A frame with body and hands scaled, the neck at its length and the face placed at the nose."""
    pose = fix_neck(scale(frame["pose_keypoints_2d"], sx, sy), neck)
    return F.struct(
        pose.alias("pose_keypoints_2d"),
        place_face(frame["face_keypoints_2d"], at(pose, NOSE, 0), at(pose, NOSE, 1), face_sx, face_sy).alias("face_keypoints_2d"),
        scale(frame["hand_left_keypoints_2d"], sx, sy).alias("hand_left_keypoints_2d"),
        scale(frame["hand_right_keypoints_2d"], sx, sy).alias("hand_right_keypoints_2d"),
    )


def triples(arr: Column | str, most: int | None = None) -> Column:
    """The array as (x, y, score, id) structs, at most ``most`` of them."""
    arr = col(arr)
    n = F.floor(F.size(arr) / 3).cast("int")
    n = F.least(n, F.lit(most)) if most is not None else n
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.struct(F.get(arr, i * 3).alias("x"), F.get(arr, i * 3 + 1).alias("y"), F.get(arr, i * 3 + 2).alias("score"), i.alias("id")))


def drop_unsure(points: Column | str, least: float = 0.01) -> Column:
    """Points that aren't sure, or not in the picture, become zeros."""
    def keep(p: Column) -> Column:
        ok = (p["score"] > least) & (p["x"] > 0) & (p["y"] > 0)
        value = lambda f: F.when(ok, p[f]).otherwise(0.0).alias(f)
        return F.struct(value("x"), value("y"), value("score"), p["id"].alias("id"))

    return F.transform(col(points), keep)


def recentre(points: Column | str, body: Column | str, fix_hip: bool = False) -> Column:
    """Points moved so that the body's neck is at (0.5, 0.4); with ``fix_hip`` point 8 is put at (0.5, 0.8). Unchanged without a neck."""
    neck = F.get(F.filter(col(body), lambda p: p["id"] == NECK), F.lit(0))

    def move(p: Column) -> Column:
        hip = (p["id"] == HIP) & F.lit(fix_hip)
        x = F.when(hip, 0.5).otherwise(p["x"] + (0.5 - neck["x"]))
        y = F.when(hip, 0.8).otherwise(p["y"] + (0.4 - neck["y"]))
        return F.struct(x.alias("x"), y.alias("y"), p["score"].alias("score"), p["id"].alias("id"))

    return F.when(neck.isNull(), col(points)).otherwise(F.transform(col(points), move))


def confidence(frame: Column) -> Column:
    """The sum of confidences of all arrays of a frame."""
    total = F.lit(0.0)
    for key in KEYPOINT_KEYS:
        total = total + F.aggregate(strided(F.coalesce(frame[key], F.array().cast("array<double>")), 2), F.lit(0.0), lambda a, v: a + v)
    return total


def mean_confidence(sequence: Column | str) -> Column:
    """The mean confidence of a sequence's frames; 0 if it has none."""
    seq = col(sequence)
    return F.when(F.size(seq) > 0, F.aggregate(seq, F.lit(0.0), lambda a, f: a + confidence(f)) / F.size(seq)).otherwise(0.0)


def is_corrupt(sequence: Column | str, sizes: tuple[int, ...] = STORED_SIZES) -> Column:
    """Whether any frame has an array of another size."""
    wrong = lambda f: F.array_contains(F.array(*(F.coalesce(F.size(f[k]), F.lit(0)) != n for k, n in zip(KEYPOINT_KEYS, sizes, strict=True))), True)
    return F.exists(col(sequence), wrong)


def positions(frame: Column, keys: tuple[str, ...] = ("pose_keypoints_2d", "hand_left_keypoints_2d", "hand_right_keypoints_2d", "face_keypoints_2d")) -> Column:
    """All x and y of a frame, without confidences, as one array."""
    return F.concat(*(F.filter(frame[k], lambda v, i: i % 3 != 2) for k in keys))


def blend(a: Column | str, b: Column | str, alpha: Column) -> Column:
    """Between two arrays: x and y mixed, confidence of the second; as many whole triples as both have."""
    n = (F.floor(F.least(F.size(col(a)), F.size(col(b))) / 3) * 3).cast("int")
    pairs = F.zip_with(F.slice(col(a), 1, n), F.slice(col(b), 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(pairs, lambda p, i: F.when(i % 3 == 2, p["y"]).otherwise(p["x"] * (1 - alpha) + p["y"] * alpha))


def blend_frames(a: Column, b: Column, alpha: Column) -> Column:
    return F.struct(*(blend(a[k], b[k], alpha).alias(k) for k in KEYPOINT_KEYS))


def between_frames(a: Column, b: Column, n: Column) -> Column:
    """``n`` frames between two, evenly spaced."""
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: blend_frames(a, b, i / (n + 1)))


def stretch(sequence: Column | str, target: Column, blender=between_frames) -> Column:
    """A sequence stretched to ``target`` frames: the missing ones are spread over the gaps, the first gaps get one more. Unchanged if it has under two frames or enough."""
    seq = col(sequence)
    gaps, extra = F.size(seq) - 1, target - F.size(seq)
    count = lambda i: (F.floor(extra / gaps) + F.when(i < extra % gaps, 1).otherwise(0)).cast("int")
    parts = F.transform(F.slice(seq, 1, gaps), lambda f, i: F.concat(F.array(f), blender(f, F.get(seq, i + 1), count(i))))
    return F.when((F.size(seq) < 2) | (F.size(seq) >= target) | target.isNull(), seq).otherwise(F.concat(F.flatten(parts), F.slice(seq, -1, 1)))
