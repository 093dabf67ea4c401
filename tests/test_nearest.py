import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetext.operators import matching, nearest


def table(spark, ids, x, name):
    return spark.createDataFrame(pa.table({name: pa.array(ids, pa.int64()), "embedding": pa.array([None if v is None else np.asarray(v, float) for v in x], pa.list_(pa.float64()))})).repartition(3)


def brute(q_ids, q, t_ids, t, k):
    """Neighbours by similarity, then by id."""
    out = []
    for i, a in zip(q_ids, q, strict=True):
        if a is None:
            continue
        a, rows = np.asarray(a, float), []
        for j, b in zip(t_ids, t, strict=True):
            if b is None or j == i:
                continue
            b = np.asarray(b, float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            rows.append((-round(float(a @ b) / norm, 9) if norm else 0.0, j))
        out += [(i, j, n + 1) for n, (_, j) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_odd_vectors(spark, monkeypatch, pairs):
    """Both ways, with ties, zero and null vectors, copies, and pieces of a few rows."""
    monkeypatch.setattr(matching, "FEW_PAIRS", pairs)
    monkeypatch.setattr(nearest, "PIECE_ROWS", 5)
    monkeypatch.setattr(nearest, "PART", 7)
    rng = np.random.default_rng(3)
    x = [*rng.normal(size=(60, 5)), np.zeros(5), None, np.ones(5), np.ones(5), 2 * np.ones(5), *[np.eye(5)[0]] * 20, np.zeros(5)]
    ids = list(range(len(x)))
    got = matching.nearest_cosine(table(spark, ids, x, "q_id"), table(spark, ids, x, "t_id"), 3, skip_self=True)
    want = brute(ids, x, ids, x, 3)
    assert sorted((r["q_id"], r["t_id"], r["rank"]) for r in got.collect()) == want
    few = table(spark, [1], [x[1]], "t_id")
    assert matching.nearest_cosine(table(spark, ids, x, "q_id"), few, 3, skip_self=True).count() == len(ids) - 2
    assert matching.nearest_cosine(table(spark, ids, x, "q_id"), few.limit(0), 3).count() == 0
    assert matching.nearest_cosine(table(spark, ids, x, "q_id").limit(0), few, 3).count() == 0


def test_most_pairs_are_ruled_out(spark):
    rng = np.random.default_rng(5)
    n, centres = 20_000, rng.normal(size=(80, 24))
    x = centres[rng.integers(0, 80, n)] + 0.15 * rng.normal(size=(n, 24))
    ids = np.arange(n)
    rows = table(spark, ids, list(x), "t_id").select(F.col("t_id").alias("t_"), F.col("embedding").alias("v_"))
    asked = table(spark, ids[:400], list(x[:400]), "q_id").select(F.col("q_id").alias("q_"), F.col("embedding").alias("qv_"))
    found, met = nearest.pruned(asked, rows, 5, lambda a, b: matching._best(a, b, 5, False).combine_chunks(), ("bigint", "bigint"))
    compared = met.agg(F.sum("n_")).first()[0]
    assert compared < 0.5 * 400 * n
    got = {}
    for r in found.orderBy("q_", F.desc("similarity"), "t_").collect():
        got.setdefault(r["q_"], []).append(r["t_"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(400):
        sim = u @ u[q]
        assert set(list(dict.fromkeys(got[q]))[:5]) == set(np.argsort(-sim, kind="stable")[:5].tolist())
