import random

import pytest
from pyspark.sql import functions as F

from kinetext.operators import joins, terms

TEXTS = "id int, other string, text string"


def places(texts, words):
    return sorted((i, w, at) for i, _, x in texts if x for w in set(words) - {None, ""} for at in range(len(x)) if x.startswith(w, at))


@pytest.mark.parametrize("chars", [4 << 20, 60])
def test_all_places_of_all_terms(spark, monkeypatch, chars):
    """Also with terms in several automata."""
    monkeypatch.setattr(terms, "BLOCK_CHARS", chars)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("ab𝄞", [6, 3, 1], k=n))
    texts = [(i, "x", word(rng.randint(0, 30)) if i % 9 else None) for i in range(80)]
    words = [word(rng.randint(0, 7)) for _ in range(60)] + [None, "aaaa", "aaaa"]
    lines, known = spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame([(w,) for w in words], "term string")
    got = terms.term_positions(lines, known, ["id"])
    assert got.columns == ["id", "term", "start"]
    assert sorted(tuple(r) for r in got.collect()) == places(texts, words)
    want = {i: sorted({w for j, w, _ in places(texts, words) if j == i}) for i, _, _ in texts}
    assert {r["id"]: r["terms"] for r in terms.terms_in(lines, known, "text", "term").collect()} == want
    one = {r["id"]: r["terms"] for r in terms.terms_in(lines, known, "text", "term", first=True).collect()}
    assert all(len(one[i]) == min(1, len(want[i])) and set(one[i]) <= set(want[i]) for i in want)


def test_no_terms_and_no_texts(spark):
    lines, known = spark.createDataFrame([(1, "x", "abc"), (2, None, None)], TEXTS), spark.createDataFrame([("",), (None,)], "term string")
    assert terms.term_positions(lines, known, ["id", "other"]).collect() == []
    assert terms.term_positions(lines.limit(0), spark.createDataFrame([("a",)], "term string"), ["id"]).collect() == []
    assert [r["found"] for r in joins.contains_any(lines, known, "text", "term").orderBy("id").collect()] == [True, False]


def test_long_lists_are_not_expressions(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, None), (4, "a")], "id int, text string")
    known = spark.createDataFrame([("cde^",), ("z",), ("qq",), ("cd",)], "gloss string")
    small = {r["id"]: r["found"] for r in joins.contains_any(lines, known, "text", "gloss").collect()}
    monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
    large = {r["id"]: r["found"] for r in joins.contains_any(lines, known, "text", "gloss").collect()}
    assert small == large == {1: True, 2: True, 3: False, 4: False}
    assert all(r["found"] == (r["id"] != 3) for r in joins.contains_any(lines, known.union(spark.createDataFrame([("^",)], "gloss string")), "text", "gloss").collect())
    monkeypatch.setattr(joins, "FEW_TERMS", 1)
    got = sorted((r["id"], r["gloss"]) for r in joins.term_search(lines, known, "text", "gloss").collect())
    assert got == [(1, "cd"), (2, "z")]


def test_a_million_terms(spark):
    """Against a set of all substrings; texts go through no shuffle."""
    rng = random.Random(3)
    digits = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring(F.lit("abcdefgh"), (F.shiftrightunsigned(F.xxhash64("id", i), 7) % 8 + 1).cast("int"), F.lit(1)))
    known = spark.range(1_000_000).select(F.concat(F.array_join(digits, ""), F.when(F.col("id") % 5 == 0, "ä").otherwise("")).alias("term"))
    texts = [(i, "x", "".join(rng.choices("abcdefghä", k=4000))) for i in range(12)]
    found = terms.term_positions(spark.createDataFrame(texts, TEXTS).repartition(2), known, ["id"])
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    words = {r["term"] for r in known.collect()}
    assert len(words) > 700_000
    want = sorted((i, x[at : at + n], at) for i, _, x in texts for n in (7, 8) for at in range(len(x) - n + 1) if x[at : at + n] in words)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 5000
