"""A generator that is called again for what is still open: rounds over a shrinking set of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import delete, folder

#: text, what the text has already and must not get again, and the number of the attempt (from 0, anew for each paraphrase) -> a candidate.
Generator = Callable[[Column, Column, Column], Column]


def retried_paraphrases(df: DataFrame, generate: Generator, text: str = "full_sentence", n: int = 1, tries: int = 5) -> DataFrame:
    """``df`` with ``paraphrases``, up to ``n`` of the text, and ``calls``, how often the generator was asked for it.

    In each round the generator, the boundary to a model, is called once for
    each row that is still open, with the text and all paraphrases that it has
    so far as what to exclude. A candidate, trimmed, is taken if it isn't empty,
    excluded or degenerate; after ``tries`` attempts in a row that give none,
    the row is closed. There are ``n`` * ``tries`` rounds at most, over fewer
    and fewer rows; each round's state is written, the one before deleted, and
    other columns stay out of it. A null text is never asked for.
    """
    spark = df.sparkSession
    base, done, state = (folder(spark) for _ in range(3))
    # Numbers are written with the rows, so that a row keeps its number.
    df.withColumn("row_", F.monotonically_increasing_id()).write.parquet(base)
    rows = spark.read.parquet(base)
    own = F.trim(F.col(text).cast("string"))
    none = F.array().cast("array<string>")
    zero = F.lit(0)
    now = rows.where(F.col(text).isNotNull()).select("row_", own.alias("own_"), none.alias("taken_"), zero.alias("missed_"), zero.alias("calls_"))
    last = None
    for r in range(n * tries):
        asked = generate(F.col("own_"), F.array_insert("taken_", 1, F.col("own_")), F.col("missed_"))
        drawn = now.withColumn("x_", F.trim(F.coalesce(asked.cast("string"), F.lit(""))))
        drawn = drawn.withColumn("good_", (F.col("x_") != "") & (F.col("x_") != F.col("own_")) & ~F.array_contains("taken_", F.col("x_")) & ~F.get(X.degenerate_flags(F.array("x_")), 0))
        new = drawn.select(
            "row_", "own_", F.when(F.col("good_"), F.array_append("taken_", F.col("x_"))).otherwise(F.col("taken_")).alias("taken_"),
            F.when(F.col("good_"), 0).otherwise(F.col("missed_") + 1).alias("missed_"), (F.col("calls_") + 1).alias("calls_"),
        )
        closed = (F.size("taken_") >= n) | (F.col("missed_") >= tries)
        path = f"{state}/{r}"
        new.withColumn("closed_", closed).write.parquet(path)
        held = spark.read.parquet(path)
        held.where("closed_").select("row_", "taken_", "calls_").write.mode("append").parquet(done)
        if last:
            delete(spark, last)
        last, now = path, held.where("not closed_").drop("closed_")
        if now.isEmpty():
            break
    found = spark.read.schema("row_ long, taken_ array<string>, calls_ int").parquet(done) if last else spark.createDataFrame([], "row_ long, taken_ array<string>, calls_ int")
    return rows.join(found, "row_", "left").select(*df.columns, F.coalesce("taken_", none).alias("paraphrases"), F.coalesce("calls_", zero).alias("calls"))
