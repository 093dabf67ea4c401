import json

import pytest
from pyspark.sql import functions as F

from kinetext import schemas
from kinetext.sources import files, html, srt
from kinetext.plans import poses, transcripts
from kinetext.operators import dictionary as D

TRANSCRIPT = """1
00:00:00,000 --> 00:00:04,000
A: „Das Haus ist groß.“

2
00:00:00,500 --> 00:00:05,000
A: *HAUS1A^

3
00:00:03,000 --> 00:00:03,400
A: GROSS1||ICH1

4
00:00:03,500 --> 00:00:03,900
B: kein Satz

5
00:00:03,500 --> 00:00:03,900
C: Das sagt der Moderator.

6
00:00:09,000 --> 00:00:09,100
two
lines

7
00:00:10,000 --> 00:00:11,000
A: ICH1
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for name in ("entry_1", "entry_12"):
        (base / name).mkdir()
        (base / name / "transcript.srt").write_text("\ufeff" * (name == "entry_12") + TRANSCRIPT.replace("\n", "\r\n" if name == "entry_12" else "\n"), encoding="utf-8")
    person = {"pose_keypoints_2d": [float(i) for i in range(75)], "face_keypoints_2d": [1.0] * 210, "hand_left_keypoints_2d": [2.0] * 63, "hand_right_keypoints_2d": [3.0] * 63, "pose_keypoints_3d": [9.0]}
    doc = [{"camera": "a1", "width": 10, "height": 20, "frames": {str(f): {"people": [person]} for f in range(0, 300)}}, {"camera": "c", "frames": {"1": {"people": [person]}}}]
    (base / "entry_1" / "openpose.json").write_text(json.dumps(doc))
    (base / "types.csv").write_text("Gloss/Type\nHAUS1A^\nGROSS1\nICH1\n", encoding="utf-8")
    return str(base)


@pytest.fixture(scope="module")
def blocks(spark, root):
    return srt.scan_strict(srt.files(spark, f"{root}/entry_1/transcript.srt"))


@pytest.fixture(scope="module")
def types(spark, root):
    return files.first_column(spark, f"{root}/types.csv")


def test_scans(spark, root, blocks):
    assert sorted(r["entry"] for r in srt.files(spark, f"{root}/entry_*/transcript.srt").collect()) == ["entry_1", "entry_12"]
    got = blocks.orderBy("pos").collect()
    assert [r["block_idx"] for r in got] == [1, 2, 3, 4, 5, 7]
    assert (got[1]["start_ms"], got[1]["end_ms"], got[1]["text"]) == (500, 5000, "A: *HAUS1A^")
    lenient = srt.scan_lenient(srt.files(spark, f"{root}/entry_1/transcript.srt")).where("block_idx = 6").first()
    assert lenient["text"] == "two\nlines"
    checked = srt.scan_checked(srt.files(spark, f"{root}/entry_12/transcript.srt")).orderBy("pos").collect()
    assert [r["text"] for r in checked][5] == "two lines" and len(checked) == 7
    assert [r["entry"] for r in srt.with_all(spark, root, ["transcript.srt", "openpose.json"]).collect()] == ["entry_1"]


def test_last_duplicate_index_wins(spark):
    df = spark.createDataFrame([("p", 1, 0, "a"), ("p", 1, 5, "b"), ("p", 2, 3, "c")], "path string, block_idx int, pos int, text string")
    assert sorted(r["text"] for r in srt.last_by_index(df).collect()) == ["b", "c"]


def test_transcript_to_corpus(spark, blocks, types):
    marked = transcripts.marked_blocks(blocks, types)
    got = [(r["text"], r["start_ms"], r["end_ms"], r["is_full"], r["is_end"]) for r in marked.orderBy("pos").collect()]
    assert got == [("„Das Haus ist groß.“", 0, 4000, True, False), ("HAUS1A", 500, 2500, False, False), ("GROSS1", 3000, 3400, False, False), ("ICH1", 3000, 3400, False, True), ("ICH1", 10000, 11000, False, False)]
    (pair,) = transcripts.parallel_corpus(blocks, types).collect()
    assert (pair["full_sentence"], pair["glosses"]) == ("„Das Haus ist groß.“", "HAUS1A,GROSS1,ICH1")
    (clip,) = transcripts.sentence_videos(transcripts.parallel_corpus(blocks, types), "/v").collect()
    assert (clip["video_path"], clip["start_time"], clip["end_time"]) == ("/v/entry_1/video-a.mp4", "00:00:00.000", "00:00:04.000")
    known = spark.createDataFrame([("HAUS1A",), ("GROSS1",), ("ICH1",)], "gloss string")
    times = {(r["gloss"], r["block_index"]): (r["gd"], r["igt"], r["ogt"], r["tgt"], r["lost"]) for r in transcripts.timing_table(blocks, known).collect()}
    assert times == {("HAUS1A", "2"): (2000, 0, 500, 2500, False), ("GROSS1", "3"): (400, 500, 0, 900, False), ("ICH1", "4"): (400, 500, 0, 900, False), ("ICH1", "5"): (1000, 0, 0, 1000, True)}


def test_srt_round_trip(spark, blocks, tmp_path):
    marked = srt.with_markers(spark.createDataFrame([("e", 0, 0, 1500, "A: S_FULL_SENTENCE"), ("e", 1, 3_600_000, 3_600_001, "A: G_END_SENTENCE"), ("e", 2, 5, 6, "A: X_FULL_SENTENCE_END_SENTENCE")], "entry string, pos int, start_ms long, end_ms long, text string"))
    assert [(r["is_full"], r["is_end"], r["text"]) for r in marked.orderBy("pos").collect()] == [(True, False, "A: S"), (False, True, "A: G"), (True, True, "A: X")]
    srt.write(marked, str(tmp_path / "out"), text=srt.marked_text(marked))
    text = spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"]
    assert text.strip() == "1\n00:00:00,000 --> 00:00:01,500\nA: S_FULL_SENTENCE\n\n2\n01:00:00,000 --> 01:00:00,001\nA: G_END_SENTENCE\n\n3\n00:00:00,005 --> 00:00:00,006\nA: X_FULL_SENTENCE_END_SENTENCE"


def test_keypoints_to_dictionary(spark, root, blocks, types):
    cams = files.cameras(spark, f"{root}/entry_*/openpose.json")
    assert cams.count() == 2
    people = D.frames(cams)
    first = people.where("frame = 0").first()
    assert first["speaker"] == "A" and len(first["person"]["pose_keypoints_2d"]) == 39
    assert first["person"]["pose_keypoints_2d"][:3] == [0.0, 1 / 20, 2.0] and first["person"]["pose_keypoints_2d"][27] == 45 / 10
    marked = transcripts.marked_blocks(blocks, types)
    wanted = spark.createDataFrame([("HAUS1A",), ("ICH1",), ("NONE",)], "gloss string")
    found = poses.dictionary(marked, cams, wanted)
    sizes = {r["gloss"]: len(r["pose_sequence"]) for r in found.collect()}
    assert sizes["HAUS1A"] == 125 - 25 + 1 and sizes["ICH1"] in (21,)
    assert [r["gloss"] for r in D.missing_glosses(wanted, found).collect()] == ["NONE"]
    assert D.dictionary_audit(found).count() == 0
    shared = poses.dictionary(marked, cams, wanted, drop_shared=True)
    assert "ICH1" not in {r["gloss"] for r in shared.collect()}  # its frames are all shared with another gloss
    raw = cams.where("camera_no = 0").select("entry", F.col("cam.camera").alias("camera"), F.explode("cam.frames").alias("frame", "b")).select("entry", "camera", "frame", F.explode("b.people").alias("person"))
    assert D.size_audit(raw).count() == 0
    summary = D.size_audit_summary(D.size_audit(raw, sizes=(75, 210, 63, 60))).first()
    assert (summary["part"], summary["rows"], summary["frames"]) == ("hand_right_keypoints_2d", 300, 300)


def test_tables(spark, tmp_path):
    rows = [("Ein Satz, mit Komma\nund Zeile", "A,B"), ('mit "Zitat"', "C")]
    df = spark.createDataFrame(rows, schemas.PARALLEL)
    files.write_csv(df.coalesce(1), str(tmp_path / "csv"), quote_all=True)
    assert sorted(tuple(r) for r in files.csv(spark, str(tmp_path / "csv"), schemas.PARALLEL).collect()) == sorted(rows)
    both = files.with_suffix_unioned(spark, [str(tmp_path / "csv"), str(tmp_path / "missing"), str(tmp_path / "csv")], schemas.PARALLEL)
    assert both.count() == 4
    (tmp_path / "pipe.csv").write_text("orth|translation\nA  B|Text eins\n")
    assert tuple(files.csv(spark, str(tmp_path / "pipe.csv"), "orth string, translation string", sep="|").first()) == ("A  B", "Text eins")
    (tmp_path / "terms.txt").write_text("eins\n\n  \nzwei \n")
    assert sorted(r["term"] for r in files.lines(spark, str(tmp_path / "terms.txt")).collect()) == ["eins", "zwei"]
    assert [tuple(r) for r in files.literal_list(spark, "haus, ,ich1").collect()] == [(1, "HAUS"), (2, "ICH1")]
    assert files.file_sizes(spark, str(tmp_path / "terms.txt")).first()["size"] == 15


def test_pose_documents(spark, tmp_path):
    person = {k: [1.0, 2.0, 3.0] for k in schemas.KEYPOINT_KEYS}
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"gloss": "X", "pose_sequence": [person]}, {"gloss": "Y", "pose_sequence": []}]}))
    (tmp_path / "b.json").write_text("{broken")
    assert sorted((r["gloss"], r["item_no"]) for r in files.pose_items(spark, str(tmp_path)).collect()) == [("X", 0), ("Y", 1)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "dict.json").write_text(json.dumps({"X": [person, person]}))
    (row,) = files.pose_dictionary(spark, str(tmp_path / "d")).collect()
    assert row["gloss"] == "X" and len(row["pose_sequence"]) == 2
    files.write_json(spark.createDataFrame([("Ä",)], "gloss string"), str(tmp_path / "out"))
    assert "Ä" in spark.read.text(str(tmp_path / "out")).first()["value"]


def test_html_tables_and_links(spark):
    page = "<table><tr><th>Name</th><th>SRT</th></tr><tr><td>one</td><td><a href='a/x.srt'>get</a></td></tr><tr><td>two</td><td>-</td></tr></table><p><a href='/t'>HAUS1</a> (x)</p><p>ICH2^ more</p>"
    df = spark.createDataFrame([(1, "http://h.org/dir/page.html?q", page)], "page_id long, url string, html string")
    rows = html.table_rows(df, "SRT").collect()
    assert len(rows) == 1 and rows[0]["cells"]["SRT"]["link"] == "http://h.org/dir/a/x.srt" and rows[0]["cells"]["Name"]["text"] == "one"
    assert html.table_rows(df).count() == 2
    assert [r["target"] for r in html.links(df).orderBy("pos").collect()] == ["http://h.org/dir/a/x.srt", "http://h.org/t"]
    assert sorted(r["gloss"] for r in html.paragraph_terms(df).collect()) == ["HAUS1", "ICH2^"]


def test_reports_and_plans(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a")], "key string, item string")
    assert files.grouped_report(df, "key", "item").first()["value"] == "k:\n- a\n- b"
    clips = files.clip_plan(spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "s double, d double"), F.lit("v.mp4"), F.col("s"), F.col("d"), F.lit("o.mp4"))
    assert clips.count() == 1
    assert files.render_config(spark.createDataFrame([(72,)], "n int"), "num_frames: %s", ["n"]).first()["config"] == "num_frames: 72"
    assert [r["entry"] for r in files.from_entry(spark.createDataFrame([("entry_2",), ("entry_10",), ("entry_1",)], "entry string"), "entry_2").orderBy("entry").collect()] == ["entry_10", "entry_2"]
