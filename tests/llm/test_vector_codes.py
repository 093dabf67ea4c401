import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetext.llm import common, vector_codes

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, label int, embedding array<float>"


def brute(rows, parts, entries, rounds, scale=1024):
    """Rows (vec_id, label, vector) as (vec_id, code, error, label_error), and the codebooks' digest, in Python's own numbers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = -(-max((len(r[2]) for r in kept), default=0) // parts)
    most = vector_codes.limit(parts * width)
    whole = [[max(-most, min(most, math.floor(scale * x))) for x in r[2]] + [0] * (parts * width - len(r[2])) for r in kept]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut(whole[i])[p] for i in first] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), no) for no, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for v in whole]
        for p in range(parts if turn < rounds else 0):
            for no in range(len(books[p])):
                own = [cut(v)[p] for v, f in zip(whole, found, strict=True) if f[p][1] == no]
                if own:
                    books[p][no] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[1]] = sums.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{no:02x}" for _, no in f), e, sums[r[1]]) for r, f, e in zip(kept, found, errors, strict=True)), key=repr), digest


def check(spark, rows, parts=4, entries=16, rounds=3):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = vector_codes.encode(df, parts=parts, entries=entries, rounds=rounds).collect()
    want, digest = brute([tuple(r) for r in spark.createDataFrame(rows, KIND).collect()], parts, entries, rounds)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} == ({digest} if want else set())


@pytest.mark.parametrize("entries", [1, 16, 200])
def test_codes_match_plain_version(spark, entries):
    rng = random.Random(entries)
    check(spark, [(rng.randrange(200), rng.choice([None, 1, 2]), [rng.gauss(0, 1) for _ in range(8)]) for _ in range(150)], entries=entries)


def test_odd_vectors(spark):
    rows = [
        (1, 1, None), (2, 1, [NAN, 1.0]), (3, 1, [INF, 1.0]), (4, 1, [None, 1.0]), (5, None, []), (None, 1, [1.0, 2.0]), (6, 1, [0.0, 0.0, 0.0]), (6, 1, [0.0, 0.0, 0.0]), (7, 2, [-0.0001]),
        (8, 2, [3e38, -3e38, 1.0, 1.0, 1.0]), (9, None, [0.1] * 10), (9, None, [0.2] * 10), *((i, 3, [0.5, 0.5]) for i in range(20, 60)),
    ]
    check(spark, rows, entries=4)
    check(spark, [(1, None, []), (2, None, [])])
    check(spark, [(1, 1, None)])
    assert vector_codes.encode(spark.createDataFrame([], KIND)).count() == 0


def test_bounds_hold_and_rule_out_entries():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (32, 8))
    entries = centres[rng.integers(0, 32, 256)] + rng.integers(-50, 50, (256, 8))
    x = centres[rng.integers(0, 32, 1000)] + rng.integers(-50, 50, (1000, 8))
    cells = vector_codes.Cells(entries)
    low, high = cells.bounds(x)
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    code, error, compared = cells.nearest(x)
    assert (code == exact.argmin(1)).all() and (error == exact.min(1)).all()
    assert compared < 0.3 * exact.size


def test_clashing_columns_and_no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_LIMIT", -1)
    df = spark.createDataFrame([(i, i % 3 or None, [float(i), 1.0]) for i in range(30)], KIND).withColumns({c: F.lit(1) for c in ("id", "v", "spot", "at", "value", "__key", "__total", "Code", "error", "x")})
    out = vector_codes.encode(df, entries=4)
    assert out.columns == ["vec_id", "label", "id", "v", "spot", "at", "value", "__key", "__total", "x", "code", "error", "label_error", "codebooks_sha256"]
    assert out.where("id = 1 AND v = 1 AND __key = 1 AND x = 1").count() == 30
    sums = {}
    for r in out.collect():
        sums.setdefault((r["label"], r["label_error"]), []).append(r["error"])
    assert len(sums) == 3 and all(k[1] == sum(v) for k, v in sums.items())
