import json
import random

import pytest
from pyspark.sql import functions as F

from kinetext.operators import dictionary
from kinetext.sources import files, nested


def value(rng, depth):
    kind = rng.randint(0, 5 if depth else 3)
    if kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if kind == 5:
        return {text(rng): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [rng.randint(-9, 9), text(rng), None, 1.5][kind]


def text(rng):
    return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "ä", "𝄞", "\n", " "], k=rng.randint(0, 9)))


def plain(doc, depth, level=1):
    """Items at ``depth``, as (key or None, value)."""
    pairs = list(doc.items()) if isinstance(doc, dict) else [(None, x) for x in doc]
    if level == depth:
        return pairs
    return [y for _, x in pairs if isinstance(x, dict | list) for y in plain(x, depth, level + 1)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_items_of_random_documents(spark, tmp_path, depth):
    rng = random.Random(depth)
    want = []
    for i in range(12):
        doc = [value(rng, 4) for _ in range(6)] if i % 2 else {f"k{j}": value(rng, 4) for j in range(6)}
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, ensure_ascii=bool(i % 3), indent=rng.choice([None, 2])))
        want += [json.dumps(x) for x in plain(doc, depth)]
    for block in (7, 61, 1 << 20):
        found = nested.parts(spark, f"{tmp_path}/*.json", depth, block).where(F.col("level") == depth).collect()

        def pair(written):
            try:
                return None, json.loads(written)
            except ValueError:
                return next(iter(json.loads("{" + written + "}").items()))

        assert sorted(json.dumps(pair(r["text"])) for r in found) == sorted(want), block


def document(rng, n):
    person = lambda: {"pose_keypoints_2d": [rng.random() for _ in range(75)], "face_keypoints_2d": [0.5] * 6, "hand_left_keypoints_2d": [1], "hand_right_keypoints_2d": [], "pose_keypoints_3d": [9.0]}
    frames = {str(i): {"people": [person() for _ in range(rng.randint(0, 2))], "note": 'a "}{ [\\'} for i in range(n)}
    return [{"frames": frames, "camera": "a1", "width": 640, "height": 360}, {"camera": "b1", "tags": {"frames": 1}, "height": 2, "more": [1, {"width": 3}], "frames": frames}, {"camera": "c", "width": 1, "height": 1, "frames": {}}, {"camera": "d", "frames": {"0": {"people": []}}}]


def test_frames_equal_those_of_whole_documents(spark, tmp_path):
    rng = random.Random(1)
    for e in range(2):
        (tmp_path / f"entry_{e}").mkdir()
        (tmp_path / f"entry_{e}" / "openpose.json").write_text(json.dumps(document(rng, 15)))
    path = f"{tmp_path}/*/openpose.json"
    rows = lambda df: sorted((r["entry"], r["camera_no"], r["speaker"] or "", r["frame"], r["person_no"], str(r["person"])) for r in df.collect())
    want = rows(dictionary.frames(files.cameras(spark, path)))
    assert len(want) > 40
    for block in (500, 1 << 22):
        assert rows(dictionary.people(nested.camera_frames(spark, path, block))) == want


def test_dictionary_and_broken_documents(spark, tmp_path):
    whole = {f"G{i}": [{"pose_keypoints_2d": [float(i)]}] * (i % 3) for i in range(40)}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    (tmp_path / "b.json").write_text(json.dumps(whole).replace("G", "H")[:-9])  # ends within the last sequence
    (tmp_path / "c.json").write_text("")
    got = {r["gloss"]: len(r["pose_sequence"]) for r in nested.pose_dictionary(spark, f"{tmp_path}/*.json", 90).collect()}
    assert got == {f"G{i}": i % 3 for i in range(40)} | {f"H{i}": i % 3 for i in range(39)}


def test_one_document_in_many_tasks(spark, tmp_path):
    line = json.dumps({"people": [{"pose_keypoints_2d": [0.25] * 75}]})
    with open(tmp_path / "entry_1.json", "w") as f:
        f.write('[{"camera": "a1", "width": 1, "height": 1, "frames": {')
        f.write(", ".join(f'"{i}": {line}' for i in range(60_000)))
        f.write("}}]")
    found = nested.camera_frames(spark, f"{tmp_path}/entry_1.json")
    assert found.count() == 60_000 and found.agg(F.sum(F.col("frame").cast("long"))).first()[0] == 60_000 * 59_999 // 2
    assert (tmp_path / "entry_1.json").stat().st_size > 6 * nested.BLOCK  # a task each
