import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinetext.functions import keypoints as K
from kinetext.functions import text as X
from kinetext.operators import corpus, joins, matching, motion, scoring, timing
from kinetext.plans import poses
from kinetext.schemas import KEYPOINT_KEYS


def one(spark, c, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(c.alias("x")).first()["x"]


def test_times(spark):
    assert one(spark, X.srt_to_ms(F.lit("01:02:03,456"))) == 3723456
    assert one(spark, X.ms_to_clock(F.lit(3723456))) == "01:02:03,456"
    assert one(spark, X.seconds_to_clock(F.lit(3723.4564))) == "01:02:03.456"
    assert one(spark, X.ms_to_frame(F.lit(2519))) == 125
    assert [one(spark, X.ms_to_frames_rounded(F.lit(ms))) for ms in (50, 70, 30)] == [2, 4, 2]


def test_lines(spark):
    assert one(spark, X.clean_line(F.lit("A: ||*HAUS^||"))) == "A: HAUS"
    for line, want in (("A: Das ist", True), ("A: das ist", False), ("B: 12 Leute", True), ("B: 12", False), ("C: X", False), ("D: Das", False)):
        assert one(spark, X.is_sentence(F.lit(line))) is want, line
    assert one(spark, X.base_gloss(F.lit("A_FULL_SENTENCE_END_SENTENCE"))) == "A_FULL_SENTENCE"
    assert one(spark, X.safe_name(F.lit("Ä  ß? name.txt"))) == "A_name.txt"
    assert one(spark, X.safe_name(F.lit("???"))) == "untitled"
    assert one(spark, X.nfc(F.lit("A\u0308"))) == "Ä"
    assert one(spark, X.after_last(F.lit("a<think> b <think> c "))) == "c"
    assert one(spark, X.comma_list(F.lit(" A  B C "))) == "A,B,C"


def test_degenerate():
    assert X.repeats_dominate("a b a b a b".split())
    assert not X.repeats_dominate("a b c d e".split())
    assert not X.repeats_dominate("a a a a".split())
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        want = len(w) >= 5 and any(
            c > 1 and c * n / len(w) > 0.5 for n in range(1, min(10, len(w)) + 1) for grams in [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)]] for c in [max(map(grams.count, grams))]
        )
        assert X.repeats_dominate(w) == want


def test_image_geometry(spark):
    assert tuple(one(spark, X.target_size(F.lit(1920), F.lit(1080), 576))) == (1024, 576, 1024, 576)
    assert tuple(one(spark, X.target_size(F.lit(1000), F.lit(1000), 576))) == (1024, 1024, 576, 1024)


def person(f):
    return Row(**{k: [float(f(i, k)) for i in range(n)] for k, n in zip(KEYPOINT_KEYS, (39, 210, 63, 63), strict=True)})


def test_points(spark):
    arr = [float(i) for i in range(75)]
    kept = one(spark, K.select_points(F.col("a")), a=arr)
    assert len(kept) == 39 and kept[27:30] == [45.0, 46.0, 47.0]
    back = one(spark, K.restore_points(F.col("a")), a=kept)
    assert len(back) == 75 and back[45:48] == [45.0, 46.0, 47.0] and back[27:45] == [0.0] * 18 and back[:27] == arr[:27]
    assert one(spark, K.normalize(F.col("a"), F.lit(None).cast("int"), F.lit(2)), a=[4.0, 4.0, 0.5]) == [4.0, 2.0, 0.5]
    assert one(spark, K.strided(F.col("a"), 1), a=arr[:9]) == [1.0, 4.0, 7.0]
    moved = one(spark, K.fix_neck(F.col("a"), F.lit(10.0)), a=[3.0, 4.0, 1.0, 0.0, 0.0, 1.0])
    assert moved == [6.0, 8.0, 1.0, 0.0, 0.0, 1.0]
    still = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert one(spark, K.fix_neck(F.col("a"), F.lit(10.0)), a=still) == still


def test_confidence_and_corruption(spark):
    good, bad = person(lambda i, k: i % 3 == 2), Row(**{k: [1.0] * 3 for k in KEYPOINT_KEYS})
    df = spark.createDataFrame([(1, [good, good]), (2, [good, bad])], "id int, s array<struct<pose_keypoints_2d:array<double>,face_keypoints_2d:array<double>,hand_left_keypoints_2d:array<double>,hand_right_keypoints_2d:array<double>>>")
    got = {r["id"]: (r["c"], r["m"]) for r in df.select("id", K.is_corrupt("s").alias("c"), K.mean_confidence("s").alias("m")).collect()}
    assert got[1] == (False, 125.0) and got[2][0] is True


def test_golden_interpolation(spark):
    """A jump of one keypoint gets seven frames on the straight line."""
    a, b = (0.48, 0.61), (0.36, 0.77)
    df = spark.createDataFrame([([a[0], a[1], 0.9], [b[0], b[1], 0.5])], "a array<double>, b array<double>")
    steps = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: K.blend("a", "b", i / 8))
    got = df.select(steps.alias("x")).first()["x"]
    assert got == [[(1 - i / 8) * a[0] + i / 8 * b[0], (1 - i / 8) * a[1] + i / 8 * b[1], 0.5] for i in range(1, 8)]


def naive_stretch(seq, target):
    if len(seq) < 2 or len(seq) >= target:
        return seq
    gaps, extra = len(seq) - 1, target - len(seq)
    out = []
    for i in range(gaps):
        n = extra // gaps + (i < extra % gaps)
        out.append(seq[i])
        out += [(1 - k / (n + 1)) * seq[i] + k / (n + 1) * seq[i + 1] for k in range(1, n + 1)]
    return [*out, seq[-1]]


def frames(xs):
    return [Row(**{k: [float(x), 0.0, 1.0] for k in KEYPOINT_KEYS}) for x in xs]


SEQ = "pose_sequence array<struct<pose_keypoints_2d:array<double>,face_keypoints_2d:array<double>,hand_left_keypoints_2d:array<double>,hand_right_keypoints_2d:array<double>>>"


@pytest.mark.parametrize(("n", "target"), [(1, 5), (2, 5), (3, 10), (4, 4), (5, 3), (3, None)])
def test_stretch(spark, n, target):
    df = spark.createDataFrame([(frames(range(n)), target)], f"{SEQ}, t int")
    got = [f["pose_keypoints_2d"][0] for f in df.select(K.stretch("pose_sequence", F.col("t")).alias("x")).first()["x"]]
    assert got == pytest.approx(naive_stretch([float(i) for i in range(n)], target or 0))


def test_translate_list(spark):
    dictionary = spark.createDataFrame([("HAUS1A", frames([1, 2])), ("ICH2", frames([10])), ("GEHEN1", frames([20, 30]))], f"gloss string, {SEQ}")
    glosses = dictionary.select("gloss", F.monotonically_increasing_id().alias("idx"))
    queries = spark.createDataFrame([(1, 1, "haus"), (1, 2, "zzz"), (1, 3, "ich2"), (1, 4, "gehen11"), (2, 1, "ich")], "query int, pos int, q string")
    times = spark.createDataFrame([("HAUS1A", 40.0, 60.0, 80.0), ("ICH2", 20.0, 100.0, 20.0)], "gloss string, median_igt double, median_ogt double, median_gd double")
    got = {r["query"]: [round(f["pose_keypoints_2d"][0], 6) for f in r["pose_sequence"]] for r in poses.translate(queries, glosses, dictionary, times).collect()}
    first = [1.0, round(1 + 1 / 3, 6), round(1 + 2 / 3, 6), 2.0]  # stretched to 80 ms
    gap = [round(2 + 8 * i / 3, 6) for i in (1, 2)]  # (60 + 20) / 2 ms: two frames
    into = [round(10 + 10 * i / 8, 6) for i in range(1, 8)]  # unknown: seven
    assert got == {1: [*first, *gap, 10.0, *into, 20.0, 30.0], 2: [10.0]}


def test_scaling_to_the_first(spark):
    def body(scale):
        pose = np.zeros((13, 3))
        pose[0], pose[1], pose[2], pose[5], pose[8] = (0, 0, 1), (0, 2, 1), (-2, 2, 1), (2, 2, 1), (0, 8, 1)
        face = np.stack([np.arange(70) % 7, np.arange(70) // 7, np.ones(70)], 1)
        values = {"pose_keypoints_2d": pose, "face_keypoints_2d": face, "hand_left_keypoints_2d": np.ones((21, 3)), "hand_right_keypoints_2d": np.ones((21, 3))}
        return Row(**{k: (v * [scale, scale, 1]).ravel().tolist() for k, v in values.items()})

    df = spark.createDataFrame([(1, 1, [body(1.0)]), (1, 2, [body(2.0)])], f"query int, pos int, {SEQ}")
    out = {r["pos"]: r["pose_sequence"][0] for r in motion.scale_to_first(df).collect()}
    assert out[2]["pose_keypoints_2d"] == pytest.approx(out[1]["pose_keypoints_2d"])
    face, ref = np.array(out[2]["face_keypoints_2d"]).reshape(-1, 3), np.array(out[1]["face_keypoints_2d"]).reshape(-1, 3)
    assert np.allclose(face[30, :2], [0, 0]) and np.allclose(np.ptp(face, 0)[:2], np.ptp(ref, 0)[:2])


def test_smoothness(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 6))
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 0, [0.0] * 6)], "s int, f int, xy array<double>")
    jerk = np.diff(x, n=3, axis=0)
    speed = np.linalg.norm(np.diff(x, axis=0), axis=1)
    m = np.abs(np.fft.fft(speed))[: len(speed) // 2 + 1]
    cut = np.where(np.cumsum(m) / m.sum() >= 0.99)[0][0]
    step = np.fft.fftfreq(len(speed))[1]
    (got,) = motion.smoothness(df, ["s"], "f", "xy").collect()
    assert got["msj"] == pytest.approx((np.linalg.norm(jerk, axis=1) ** 2).mean())
    assert got["sal"] == pytest.approx(-np.sqrt(np.diff(m[: cut + 1]) ** 2 + step**2).sum())
    table = motion.smoothness_table(motion.smoothness(df, ["s"], "f", "xy").withColumn("label", F.lit("a")), "label", ["a"]).first()
    assert table["a_mean_msj"] is not None


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_indel_ratio():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABCÄ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        want = 100.0 if not a and not b else 200.0 * naive_lcs(a, b) / (len(a) + len(b))
        assert matching.indel_ratio(a, b) == pytest.approx(want)


def test_fuzzy_finds_what_brute_force_finds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ABCD") for _ in range(rng.randint(1, 8)))
    table = list(dict.fromkeys(word() for _ in range(60)))
    asked = list(dict.fromkeys(word() for _ in range(60)))
    want = {}
    for q in asked:
        best = max(((matching.indel_ratio(q, g), -i, g) for i, g in enumerate(table)))
        want[q] = best[2] if best[0] >= 80 else None
    got = matching.fuzzy_match(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame([(g, i) for i, g in enumerate(table)], "gloss string, idx int"))
    assert {r["q"]: r["match"] for r in got.collect()} == want


def test_cascade_stages(spark):
    glosses = spark.createDataFrame([("HAUS1B", 0), ("HAUS1A", 1), ("HAUS", 2), ("BAUM", 3), ("GEHEN2", 4)], "gloss string, idx int")
    queries = spark.createDataFrame([("haus",), ("haus7",), ("baum9",), ("gehen",), ("BAUMM-",), ("xyz",), ("qqq",)], "q string")
    nearest = spark.createDataFrame([("XYZ", "BAUM")], "q string, match string")
    got = {r["q"]: (r["match"], r["stage"]) for r in matching.cascade(queries, glosses, nearest).collect()}
    assert got == {"HAUS": ("HAUS", "exact"), "HAUS7": ("HAUS", "variant"), "BAUM9": ("BAUM", "variant"), "GEHEN": ("GEHEN2", "variant"), "BAUMM-": ("BAUM", "fuzzy"), "XYZ": ("BAUM", "nearest"), "QQQ": (None, "none")}


def test_cosine_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 4))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "t_id long, embedding array<double>")
    q = df.where("t_id % 3 = 0").withColumnRenamed("t_id", "q_id")
    got = {}
    for r in matching.nearest_cosine(q, df, 3, skip_self=True, block=5).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["t_id"]
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for i in range(0, 40, 3):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        assert [got[i][k] for k in (1, 2, 3)] == order[:3]


def test_scores(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on a mat"), (2, "a b c d e", "a b x d e")]
    df = spark.createDataFrame(rows, "id int, pred string, ref string")
    perfect = df.withColumn("pred", F.col("ref"))
    assert [round(x, 6) for x in scoring.bleu(perfect).first()] == [100.0] * 4
    assert scoring.chrf(perfect).first()[0] == pytest.approx(100)
    assert [round(x, 6) for x in scoring.rouge(perfect).first()] == [100.0] * 3
    assert scoring.wer(df).first()[0] == pytest.approx(2 / 11) and scoring.ter(df).first()[0] == pytest.approx(200 / 11)
    b = scoring.bleu(df).first()
    assert b["bleu_1"] == pytest.approx(100 * 9 / 11) and b["bleu_2"] == pytest.approx(100 * math.sqrt(9 / 11 * 5 / 9))
    r = scoring.rouge(df, stemmed=False).first()
    assert r["rouge_l"] == pytest.approx(100 * (5 / 6 + 4 / 5) / 2)


def test_edit_distance():
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert scoring.edit_distance(a, b) == row[-1]


def test_trie_expression():
    rng = random.Random(10)
    for _ in range(200):
        terms = ["".join(rng.choice("ab.^") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        text = "".join(rng.choice("ab.^") for _ in range(8))
        assert bool(re.search(joins.trie_regex(terms), text)) == any(t in text for t in terms)


def test_long_term_lists_are_joined(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, None), (4, "a")], "id int, text string")
    terms = spark.createDataFrame([("cde^",), ("z",), ("qq",), ("cd",)], "gloss string")
    small = {r["id"]: r["found"] for r in joins.contains_any(lines, terms, "text", "gloss").collect()}
    monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
    large = {r["id"]: r["found"] for r in joins.contains_any(lines, terms, "text", "gloss").collect()}
    assert small == large == {1: True, 2: True, 3: False, 4: False}
    monkeypatch.setattr(joins, "FEW_TERMS", 1)
    got = sorted((r["id"], r["gloss"]) for r in joins.term_search(lines, terms, "text", "gloss").collect())
    assert got == [(1, "cd"), (2, "z")]


def test_ngrams_cross_texts(spark):
    texts = ["a b", "", "c", "d e f g", "h"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = " ".join(texts).split()
    for n in (1, 2, 3, 4):
        got = sorted(r["ngram"] for r in corpus.ngrams(df, X.words("text"), n, "id").collect())
        assert got == sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


@pytest.mark.parametrize("rows_a_range", [7, 100, 100_000])
def test_running_sums_over_ranges(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(joins, "RANGE_ROWS", rows_a_range)
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), f"t{rng.randint(0, 20)}", i, rng.randint(0, 5), rng.choice([None, "x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, i long, n long, g string").repartition(5)
    for keys in ((), ("k",), ("g", "k")):
        got = {r["i"]: r["start"] for r in joins.running(df, F.col("n"), ["t", "i"], "start", keys).collect()}
        total, want = {}, {}
        for k, _, i, n, g in sorted(rows, key=lambda r: (r[1], r[2])):
            key = {(): 0, ("k",): k, ("g", "k"): (g, k)}[keys]
            want[i] = total.get(key, 0)
            total[key] = want[i] + n
        assert got == want


def test_ngrams_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(joins, "RANGE_ROWS", 10)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    words = " ".join(texts).split()
    for n in (2, 3, 5):
        want = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        got = corpus.ngrams(df, X.words("text"), n, "id").collect()
        assert {r["ngram"]: r["count"] for r in got} == want
        assert all(abs(r["percentage"] - r["count"] * 100 / len(words)) < 1e-9 for r in got)


def test_ngrams_split_each_text_twice_and_count_once(spark):
    rows = [(i, " ".join("abcde"[j % 5] for j in range(i % 7))) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "id long, text string").mapInArrow(read, "id long, text string")
    got = corpus.ngrams(df, X.words("text"), 3, "id").collect()
    words = " ".join(t for _, t in rows).split()
    assert {r["ngram"]: r["count"] for r in got} == Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
    assert all(abs(r["percentage"] - r["count"] * 100 / len(words)) < 1e-9 for r in got)
    assert seen.value == 2 * len(rows)  # for the ends, and for the grams
    assert corpus.ngrams(df.limit(2), X.words("text"), 3, "id").collect() == []


def test_ngrams_of_texts_count_each_gram_of_a_block_once(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None if i % 9 == 0 else "".join(rng.choices("ab.\u00e9\u6f22 \t\n\r\x0b\u00a0", k=rng.randint(0, 12))) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for words, text in ((X.words("text"), F.col("text")), (X.normalized_words("text"), X.normalized("text"))):
        lists = [r["w"] for r in df.orderBy("id").select(words.alias("w")).collect()]
        assert corpus.split_words(pa.array([r["t"] for r in df.orderBy("id").select(text.alias("t")).collect()], pa.string())).to_pylist() == lists
        stream = [w for x in lists for w in x]
        for n, block in ((1, 5), (2, 5), (3, 1 << 21)):
            monkeypatch.setattr(corpus, "GRAM_BLOCK", block)
            want = Counter(" ".join(stream[i : i + n]) for i in range(len(stream) - n + 1))
            assert {r["ngram"]: r["count"] for r in corpus.ngrams(df, text, n, "id").collect()} == want
    counted = corpus.gram_counts(pa.array([["a", "b", "a", "b"], None, ["b"], ["a", "b"]]), 2)
    assert dict(zip(*(c.to_pylist() for c in counted.columns), strict=True)) == {"a b": 3, "b a": 1}  # a row each, not one a place


def test_ngrams_share_a_constant_and_name_grams_by_whole_numbers(spark):
    rng = random.Random(12)
    for kinds in (2, 70, 40_000):  # 40,000 words take 16 bits: four don't fit 63
        texts = [[f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 3, 9000]))] for _ in range(9)]
        for n in (1, 2, 3, 4, 5, 9):
            got = corpus.gram_counts(pa.array(texts, pa.list_(pa.string())), n)
            assert dict(zip(*(c.to_pylist() for c in got.columns), strict=True)) == Counter(" ".join(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
            assert len(set(got.column("ngram").to_pylist())) == got.num_rows
    out = corpus.ngrams(spark.createDataFrame([(1, "a b a b c")], "id long, text string"), F.col("text"), 2, "id")
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()  # no row meets the total in a join
    assert {r["ngram"]: (r["count"], r["percentage"]) for r in out.collect()} == {"a b": (2, 40.0), "b a": (1, 20.0), "b c": (1, 20.0)}


def test_gram_counts_match_counters():
    rng = random.Random(11)
    pred, ref = ([rng.choices(range(4), k=rng.randint(0, 9)) for _ in range(60)] for _ in range(2))
    for orders in (range(1, 5), range(2, 3), range(1, 7)):
        got = scoring.count_matches([np.array(x, np.int64) for x in pred], [np.array(x, np.int64) for x in ref], orders)
        for i, (a, b) in enumerate(zip(pred, ref, strict=True)):
            for j, n in enumerate(orders):
                x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
                assert got[:, i, j].tolist() == [x.total(), y.total(), (x & y).total()]
    assert scoring.count_matches([], [], range(1, 3)).shape == (3, 0, 2)


def _plain_matches(a, b, n):
    x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
    return [x.total(), y.total(), (x & y).total()]


@pytest.mark.parametrize("worded", [False, True])
def test_grams_of_a_large_batch_are_counted_in_blocks(worded):
    rng = random.Random(5)
    sides = [[rng.choices("abcdeä𝄞" if not worded else ["ab", "c", "dé", "f"], k=rng.choice([0, 3, 250])) for _ in range(10_000)] for _ in range(2)]
    pred, ref = (pa.array(x if worded else ["".join(r) for r in x]) for x in sides)
    tracemalloc.start()
    got = scoring.row_matches(range(1, 7)).func(pred, ref)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # of 1.7 million words or letters
    for i in (*range(0, 10_000, 997), 9_999):
        assert [list(x) for x in zip(*(got[i][k].as_py() for k in ("pred", "ref", "matches")), strict=True)] == [_plain_matches(sides[0][i], sides[1][i], n) for n in range(1, 7)]


def test_stems_of_a_batch(monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 2)
    words = pa.array([["gone"], ["running", "sing", "running"], None, [], ["cats", "was"]]).slice(1)
    assert scoring.stems.func(words).to_pylist() == [["run", "sing", "run"], None, [], ["cat", "was"]]


def test_blocks_keep_rows_whole_and_in_order():
    a, b = pa.array([["x", "y"], None, [], ["z"] * 7, ["y", None]]).slice(1), pa.array([["p"], ["y"], ["q", "z"], ["z"], ["y"]]).slice(1)
    for most in (1, 3, 100):
        rows = [(len(x), len(y), len(set(x.tolist()) & set(y.tolist()))) for own in scoring.blocks(a, b, most=most) for x, y in zip(*own, strict=True)]
        assert rows == [(0, 1, 0), (0, 2, 0), (7, 1, 1), (2, 1, 1)]
    assert list(scoring.blocks(a.slice(0, 0), b.slice(0, 0))) == []


def test_percentiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -3.5, 1e-3, 7.25, rng.uniform(-1e6, 1e6)]), None) for _ in range(500)] + [("one", 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["metric"]): r for r in timing.summaries(df, ["g"], ["x", "y"], shares, rows=True).collect()}
    for g in ("a", "b", None, "one"):
        own = [x for k, x, _ in rows if k == g]
        assert np.allclose(got[g, "x"]["p"], np.quantile(own, shares), rtol=1e-12), g
        assert got[g, "x"]["mean"] == pytest.approx(np.mean(own)) and got[g, "x"]["n"] == got[g, ""]["n"] == len(own)
        assert got[g, "x"]["std"] == (pytest.approx(np.std(own, ddof=1)) if len(own) > 1 else None)
    assert got["one", "y"]["p"] == [2.0] * 6 and ("a", "y") not in got
    far = spark.createDataFrame([(1e9 + i % 3,) for i in range(3000)], "x double")  # little deviation far from zero
    assert timing.summaries(far, [], ["x"]).first()["std"] == pytest.approx(np.std([i % 3 for i in range(3000)], ddof=1), rel=1e-6)
    stats = {r["g"]: r for r in timing.statistics(df, ["g"], ["x", "y"]).collect()}
    assert stats[None]["median_x"] is not None and stats["a"]["median_y"] is None and stats["one"]["count"] == 1


def test_split_and_leaks(spark):
    parts = corpus.split_train_test(spark.range(101).withColumnRenamed("id", "doc"), ["doc"])
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert counts == {"test": 11, "dev": 10, "train": 80}
    train = spark.createDataFrame([("a ", "x"), ("b", "y"), (None, "z"), ("c", None)], "full_sentence string, glosses string")
    hold = spark.createDataFrame([("a", "x"), (None, "z")], "full_sentence string, glosses string")
    assert [tuple(r) for r in corpus.without_leaks(train, [hold]).collect()] == [("b", "y")]


def test_chat_and_paraphrases(spark):
    df = spark.createDataFrame([("Guten Tag",)], "full_sentence string")
    messages = df.select(corpus.chat(F.col("full_sentence"), F.lit("GUT TAG"), "Sys", "Say: {}").alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in messages] == [("system", "Sys"), ("user", "Say: Guten Tag"), ("assistant", "GUT TAG")]
    model = lambda t: F.array(t, F.lit("a a a a a a"), F.lit(" Hallo "), F.lit("Moin"))
    assert corpus.paraphrases(df, model).first()["paraphrase"] == "Hallo"
    drawn = lambda t: F.array(*(F.lit(x) for x in ("", "Eins", "Eins", "Guten Tag", "Zwei ", "a a a a a a", None, "Drei")))
    taken = lambda **options: [r["paraphrase"] for r in corpus.paraphrases(df, drawn, **options).collect()]
    assert taken(n=2) == ["Eins", "Zwei"]
    assert taken(n=5) == ["Eins", "Zwei", "Drei"]
    assert taken(n=5, tries=2) == ["Eins"]  # the second text fails twice
    assert taken(tries=1) == []
    assert corpus.paraphrases(spark.createDataFrame([(None,)], "full_sentence string"), drawn).count() == 0


def test_pairs_of_fuzzy_matches_are_not_missed(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcde", [5, 4, 3, 2, 1], k=rng.randint(1, 9))) for _ in range(150)})
    asked = sorted({"".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(60)})
    known = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "gloss string, idx int")
    got = {r["q"]: r["match"] for r in matching.fuzzy_match(spark.createDataFrame([(q,) for q in asked], "q string"), known, 70.0).collect()}
    for q in asked:
        ratio, at = max((matching.indel_ratio(q, w), -i) for i, w in enumerate(words))
        assert got[q] == (words[-at] if ratio >= 70 else None)
