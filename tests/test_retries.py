from pyspark.sql import functions as F

from kinetext.operators.retries import retried_paraphrases


def test_only_open_rows_are_asked_again(spark):
    df = spark.createDataFrame([(1, " easy "), (2, "hard"), (3, "never"), (4, None), (5, "easy")], "id int, full_sentence string")
    model = lambda t, exclude, attempt: F.when(t == "easy", F.concat(t, F.lit(" "), F.size(exclude).cast("string"))).when((t == "hard") & (attempt == 2), F.concat(t, F.size(exclude).cast("string"))).when(t == "hard", F.element_at(exclude, -1)).otherwise(F.lit("a a a a a a"))
    got = {r["id"]: (r["paraphrases"], r["calls"]) for r in retried_paraphrases(df, model, n=2, tries=3).collect()}
    assert got == {1: (["easy 1", "easy 2"], 2), 2: (["hard1", "hard2"], 6), 3: ([], 3), 4: ([], 0), 5: (["easy 1", "easy 2"], 2)}


def test_calls_shrink(spark):
    """The generator counts its calls where it runs."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(text, taken):
        calls.add(1)
        return f"{text} {taken}" if text != "stuck" else None

    df = spark.createDataFrame([(i, "stuck" if i < 3 else f"t{i}") for i in range(50)], "id int, full_sentence string").coalesce(1)
    got = retried_paraphrases(df, lambda t, exclude, attempt: count(t, F.size(exclude)), tries=5)
    assert got.agg(F.sum("calls")).first()[0] == calls.value == 47 + 3 * 5


def test_nothing_to_ask(spark):
    model = lambda t, exclude, attempt: t
    empty = spark.createDataFrame([], "full_sentence string")
    assert retried_paraphrases(empty, model).count() == 0
    assert [tuple(r) for r in retried_paraphrases(spark.createDataFrame([(None,)], "full_sentence string"), model).collect()] == [(None, [], 0)]
    assert [tuple(r) for r in retried_paraphrases(spark.createDataFrame([("x",)], "full_sentence string"), model, n=0).collect()] == [("x", [], 0)]
