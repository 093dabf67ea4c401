import random

import pytest
from pyspark.sql import functions as F

from kinetext.operators import intervals

YEAR = 365 * 86_400_000


def some(rng, n, first):
    """Intervals of 0 ms to a year, as many of each order of length; some end before they start, some ends are null."""
    out = []
    for i in range(n):
        start = rng.randint(-YEAR, YEAR) if i % 3 else rng.randint(0, 2000)
        length = rng.choice([0, 1, 2, 3, 4, 2 ** rng.randint(0, 34), rng.randint(0, 10 ** rng.randint(0, 10)), YEAR, -rng.randint(1, 5000)])
        out.append((first + i, rng.choice(["a", "b", None]), start if i % 50 else None, start + length if i % 41 else None))
    return out


@pytest.fixture(scope="module")
def both():
    rng = random.Random(5)
    return some(rng, 300, 0), some(rng, 300, 1000)


def known(*xs):
    return all(x is not None for x in xs)


def test_overlaps_of_all_lengths(spark, both):
    a, b = (spark.createDataFrame(x, f"{n} long, k string, s{n} long, e{n} long").repartition(3) for n, x in zip("ij", both, strict=True))
    got = sorted((r["i"], r["j"]) for r in intervals.overlaps(a, b, ["k"], ("si", "ei"), ("sj", "ej")).collect())
    want = sorted((x[0], y[0]) for x in both[0] for y in both[1] if known(*x, *y) and x[1] == y[1] and y[2] < x[3] and y[3] > x[2])
    assert got == want and len(want) > 2000


@pytest.mark.parametrize("closed", [True, False])
def test_points_in_intervals_of_all_lengths(spark, both, closed):
    a = spark.createDataFrame(both[0], "i long, k string, s long, e long")
    points = [(n, k, t) for n, (_, k, s, e) in enumerate(both[0] + both[1]) for t in (s, e)]
    pts = spark.createDataFrame(points, "p long, k string, t long")
    got = sorted((r["p"], r["t"], r["i"]) for r in intervals.points_in_intervals(pts, a, ["k"], "t", "s", "e", closed).collect())
    want = sorted((p, t, x[0]) for p, k, t in points for x in both[0] if known(k, t, *x) and k == x[1] and x[2] <= t and (t <= x[3] if closed else t < x[3]))
    assert got == want


def test_fractions_of_seconds(spark):
    rng = random.Random(6)
    iv = [(i, "k", s, s + rng.choice([0.001, 0.5, 40.0])) for i in range(60) for s in [rng.random() * 100]]
    pts = [(i, "k", rng.random() * 100) for i in range(200)]
    a, p = spark.createDataFrame(iv, "i long, k string, s double, e double"), spark.createDataFrame(pts, "p long, k string, t double")
    got = sorted((r["p"], r["i"]) for r in intervals.points_in_intervals(p, a, ["k"], "t", "s", "e", unit=2**-10).collect())
    assert got == sorted((q, x[0]) for q, _, t in pts for x in iv if x[2] <= t <= x[3])


def test_rows_are_bounded_by_levels(spark, both):
    a = spark.createDataFrame(both[0], "i long, k string, s long, e long")
    present = intervals.levels(a, "s", "e")
    assert max(present) == 35 and min(present) == 0
    filed = intervals._filed(a, "s", "e", 1.0).groupBy("i").count().agg(F.max("count")).first()[0]
    assert filed <= 3
    year = a.where("e - s >= 31536000000")
    found = intervals.points_in_intervals(a.select("k", F.col("s").alias("t")), year, ["k"], "t", "s", "e")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frames_of_a_long_interval(spark):
    iv = [(1, "a", 0, 10**12), (2, "a", 5, 5), (3, "a", 9, 8), (4, "b", 0, 3), (5, None, 0, 9)]
    fr = [("a", f, p) for f in (0, 5, 8, 9, 10**11) for p in range(2)] + [(None, 5, 0), ("a", None, 0)]
    a, f = spark.createDataFrame(iv, "i long, k string, f0 long, f1 long"), spark.createDataFrame(fr, "k string, frame long, person int")
    want = sorted((i, t, p) for i, k, x, y in iv for g, t, p in fr if known(k, g, t) and k == g and x <= t <= y)
    got = intervals.frames_in_intervals(a, f, ["k"], "f0", "f1", "frame")
    assert sorted((r["i"], r["frame"], r["person"]) for r in got.collect()) == want
    kept = intervals.frames_in_intervals(a, f, ["k"], "f0", "f1", "frame", ["i"])
    assert kept.columns == ["i", "k", "f0", "f1", "frame", "person"]
    assert sorted((r["i"], r["frame"], r["person"]) for r in kept.collect() if r["frame"] is not None) == want
    assert sorted(r["i"] for r in kept.collect() if r["frame"] is None) == [3, 4, 5]


def test_empty_sides(spark, both):
    a = spark.createDataFrame(both[0], "i long, k string, s long, e long")
    none = spark.createDataFrame([], "j long, k string, s2 long, e2 long")
    assert intervals.overlaps(a, none, ["k"], ("s", "e"), ("s2", "e2")).count() == 0
    assert intervals.overlaps(none, a, ["k"], ("s2", "e2"), ("s", "e")).count() == 0
    assert intervals.points_in_intervals(a.select("k", "s"), none, ["k"], "s", "s2", "e2").count() == 0
