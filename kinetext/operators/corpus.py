"""Corpus statistics, parallel corpora and chat records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import text as X
from ..sources.scratch import materialize
from .joins import anti_join, running
from .scoring import give_back

#: Words whose grams are counted at a time (of texts, bytes over GRAM_BYTES).
GRAM_BLOCK, GRAM_BYTES = 1 << 20, 6
#: Of each byte, whether it parts words as ``X.BLANKS`` does.
BLANK = np.isin(np.arange(256), list(b" \t\n\r"))


def with_share(counts: DataFrame, total: Column | None = None, count: str = "count", out: str = "percentage") -> DataFrame:
    """The share of each count in percent of ``total`` (a literal or of a one-row frame), or of their sum."""
    if total is None:
        total_row = counts.agg(F.sum(count).alias("total_"))
        return counts.crossJoin(F.broadcast(total_row)).withColumn(out, F.col(count) * 100.0 / F.col("total_")).drop("total_")
    return counts.withColumn(out, F.when(total > 0, F.col(count) * 100.0 / total).otherwise(0.0))


def frequencies(tokens: DataFrame, item: str = "token") -> DataFrame:
    """Count and share of each item; order by count, then item, when written."""
    return with_share(tokens.groupBy(item).agg(F.count(F.lit(1)).alias("count")))


def tokens(docs: DataFrame, words: Column, out: str = "token") -> DataFrame:
    return docs.select(F.explode(words).alias(out))


def length_histogram(docs: DataFrame, words: Column) -> DataFrame:
    return with_share(docs.groupBy(F.size(words).alias("length")).agg(F.count(F.lit(1)).alias("count")))


def length_statistics(docs: DataFrame, words: Column) -> DataFrame:
    n = docs.select(F.size(words).cast("double").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("count"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_samp("n").alias("std"), F.min("n").cast("long").alias("min"), F.max("n").cast("long").alias("max"))


def extreme_examples(docs: DataFrame, words: Column, text: str, order: str) -> DataFrame:
    """Shortest and longest length, how many texts have it, and the first of them."""
    sized = docs.select(F.size(words).alias("n"), F.col(text).alias("t"), F.col(order).alias("o"))
    by = sized.groupBy("n").agg(F.count(F.lit(1)).alias("texts"), F.min("o").alias("first"))  # one row per length
    pick = lambda f, name: by.agg(F.lit(name).alias("kind"), f("n").alias("length"), (F.min_by if f is F.min else F.max_by)("texts", "n").alias("texts"), (F.min_by if f is F.min else F.max_by)("first", "n").alias("o"))
    ends = pick(F.min, "shortest").unionByName(pick(F.max, "longest"))
    return ends.join(sized.select("o", "t"), "o").select("kind", F.col("length").cast("long").alias("length"), "texts", F.col("o").alias("first_id"), F.col("t").alias("example"))


def split_words(texts: pa.Array) -> pa.Array:
    """The words of each text, as ``X.words`` parts them; null and blank texts have none."""
    texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    inside = ~BLANK[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]  # words don't cross texts
    opens[at[:-1][full]] = inside[at[:-1][full]]
    closes[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.cumsum(np.concatenate([[0], ends - starts])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at), pa.int32()), words)


def _sizes(texts: pa.Array) -> np.ndarray:
    """Words of lists, bytes of texts over GRAM_BYTES; none for null."""
    lists = pa.types.is_list(texts.type)
    n = (pc.list_value_length if lists else pc.binary_length)(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n if lists else n // GRAM_BYTES


def _by_block(of: Callable[[pa.Array, pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``of`` makes of the words in column ``w`` (lists of words, or texts) and their rows, a block of about GRAM_BLOCK words at a time (single rows may be larger)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, start = np.cumsum(np.concatenate([[0], _sizes(batch.column("w"))])), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GRAM_BLOCK, "right")) - 1)
                own = batch.slice(start, stop - start)
                yield of(own.column("w") if pa.types.is_list(own.column("w").type) else split_words(own.column("w")), own)
                start = stop
        give_back()

    return run


def gram_counts(texts: pa.Array, n: int) -> pa.RecordBatch:
    """Grams of n words inside texts (lists of words) and their counts. A gram is one whole number, its words' numbers side by side; where they don't fit, those so far are numbered anew. Sorted numbers are counted, and each distinct one is spelled once."""
    words = texts.flatten().dictionary_encode()
    word, names, sizes = words.indices.to_numpy().astype(np.int64), words.dictionary, _sizes(texts)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words from here to the end of the text
    place = np.flatnonzero(left >= n)
    bits = width = len(names).bit_length()
    gram, renamed = word[place], {}
    for k in range(1, n):
        if width + bits > 63:
            coded = pa.array(gram).dictionary_encode()
            gram, renamed[k] = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
            width = len(renamed[k]).bit_length()
        gram = gram << bits | word[place + k]
        width += bits
    gram.sort()
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    count, gram, spelled = np.diff(first, append=len(gram)), gram[first], []
    for k in range(n - 1, 0, -1):
        spelled.append(names.take(pa.array(gram & (1 << bits) - 1)))
        gram >>= bits
        gram = renamed[k][gram] if k in renamed else gram
    spelled.append(names.take(pa.array(gram)))
    return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*reversed(spelled), " "), pa.array(count, pa.int64())], names=["ngram", "n"])


def text_ends(texts: pa.Array, k: int) -> list[pa.Array]:
    """Of each text its number of words, its first k words and its last k."""
    sizes, flat = _sizes(texts), texts.flatten()
    kept, stop = np.minimum(sizes, k), np.cumsum(sizes)
    at = np.cumsum(np.concatenate([[0], kept]))
    within = np.arange(at[-1]) - np.repeat(at[:-1], kept)
    some = lambda first: pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat.take(pa.array(np.repeat(first, kept) + within)))
    return [pa.array(sizes), some(stop - sizes), some(stop - kept)]


def ngrams(docs: DataFrame, words: Column, n: int, order: str) -> DataFrame:
    """Counts and shares of n-grams over the corpus as one stream in ``order``: they cross the borders of texts; shares are of all words.

    ``words`` are lists of words, or texts, which are split as ``X.words``
    does. Inside texts, grams are counted block by block of words, and a
    block's distinct ones are shuffled, each once. For those across borders
    only the first and last words of each text travel: a text's rank says
    whose words follow its own.
    """
    base = docs.select(F.col(order).alias("o"), words.alias("w"))
    counted = lambda df: df.select("w").mapInArrow(_by_block(lambda w, _: gram_counts(w, n)), "ngram string, n long")
    grams = counted(base)
    if n > 1:
        # The texts are split into words once for the ends, and their sizes say how many words there are: the counts are made but once.
        fields = [base.schema["o"], StructField("size", LongType()), StructField("head", ArrayType(StringType())), StructField("tail", ArrayType(StringType()))]
        ends_of = _by_block(lambda w, own: pa.RecordBatch.from_arrays([own.column("o"), *text_ends(w, n - 1)], names=["o", "size", "head", "tail"]))
        ends = materialize(base.mapInArrow(ends_of, StructType(fields)).where("size > 0"))
        ranked = running(ends.drop("size"), F.lit(1), ["o"], "rank")
        # Each of the n - 1 texts that follow has a word at least.
        sent = ranked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.col("rank") - i).alias("rank"), i.alias("i"), F.when(i == 0, F.col("tail")).otherwise(F.col("head")).alias("w")))).alias("x")).select("x.*")
        joined = sent.where("rank >= 0").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("parts"))  # n parts
        following = F.slice(F.flatten(F.transform(F.slice("parts", 2, n), lambda x: x["w"])), 1, n - 1)
        grams = grams.unionByName(counted(joined.select(F.concat(F.get("parts", F.lit(0))["w"], following).alias("w"))))
    # Most of a block's grams are rare: they are shuffled as they are, not first looked up among all of a task's.
    counts = grams.repartition("ngram").groupBy("ngram").agg(F.sum("n").alias("count"))
    if n == 1:
        return with_share(counts)
    # With the total known, the share of the many grams that occur once is a constant, which is also rounded once.
    total = ends.agg(F.sum("size")).first()[0] or 1
    return counts.withColumn("percentage", F.when(F.col("count") == 1, F.lit(100.0 / total)).otherwise(F.col("count") * 100.0 / total))


def diversity(docs: DataFrame, words: Column) -> DataFrame:
    """Tokens, types, types that occur once, Guiraud's R, and the mean share of types in a text (texts without words don't count)."""
    w = docs.select(words.alias("w"))
    counts = tokens(w, F.col("w")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") == 1).alias("hapax"))
    ratio = w.agg(F.avg(F.try_divide(F.size(F.array_distinct("w")), F.size("w"))).alias("mean_ttr"))
    return whole.crossJoin(ratio).withColumn("guiraud", F.try_divide("types", F.sqrt("tokens")))


def frequency_buckets(counts: DataFrame, count: str = "count") -> DataFrame:
    """How many items are how frequent; the buckets overlap."""
    c = F.col(count)
    mids = counts.agg(F.ceil(F.avg(c)).alias("mean_"), F.median(c).alias("median_"))
    both = counts.crossJoin(F.broadcast(mids))
    named = {">1000": c > 1000, "100-1000": c.between(100, 1000), "<100": c < 100, "<=average_occurrence": c <= F.col("mean_"), "<=median_occurrence": c <= F.col("median_"), "<=10": c <= 10, "<=2": c <= 2, "==1": c == 1}
    row = both.agg(*(F.count_if(cond).alias(f"b{i}") for i, cond in enumerate(named.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"b{i}").alias("items")) for i, name in enumerate(named)))).alias("x")).select("x.*")


def box_plot(df: DataFrame, value: str) -> DataFrame:
    """Quartiles, their range, and whiskers of 1.5 ranges, clipped to the data."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    q = q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "lo", "hi").withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.select("q1", "median", "q3", "iqr", F.greatest("lo", F.col("q1") - 1.5 * F.col("iqr")).alias("low_whisker"), F.least("hi", F.col("q3") + 1.5 * F.col("iqr")).alias("high_whisker"))


def percent_to_count(percent: Column, total: Column | int) -> Column:
    return F.bround(percent / 100.0 * total).cast("int")


def reduction(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each stage's size in percent of the first stage's."""
    first = df.agg(F.min_by(value, order).alias("first_"))
    return df.crossJoin(F.broadcast(first)).withColumn("percent", F.col(value) * 100.0 / F.col("first_")).drop("first_")


def split_train_test(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seeds: Sequence[int] = (1,), mix: Callable[[int], Column] | None = None) -> DataFrame:
    """Each row with ``part`` (train, dev or test) once for every seed, in column ``seed``.

    Numbers are exact: test and dev share ``test_share``, rounded up, and the
    larger half is test. A split orders rows by ``mix`` of the seed, a hash of
    their ``keys`` (together distinct) and the seed if not given.
    """
    n = df.count()
    held = -(-int(round(n * test_share * 1_000_000)) // 1_000_000)
    test = -(-held // 2)
    out = None
    for seed in seeds:
        ranked = running(df.withColumn("key_", mix(seed) if mix else F.xxhash64(*keys, F.lit(seed))), F.lit(1), ["key_", *keys], "rank_")
        part = F.when(F.col("rank_") < test, "test").when(F.col("rank_") < held, "dev").otherwise("train")
        one = ranked.withColumns({"seed": F.lit(seed), "part": part}).drop("key_", "rank_")
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(train: DataFrame, holdouts: Sequence[DataFrame], keys: Sequence[str] = ("full_sentence", "glosses")) -> DataFrame:
    """Rows with all keys, less those that any holdout has too."""
    out = train.dropna(subset=list(keys))
    for h in holdouts:
        out = anti_join(out, h, keys)
    return out


def column_union(df: DataFrame, *columns: str) -> DataFrame:
    """Several text columns as one, with blank ones dropped."""
    out = df.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("text"))
    return out.where(F.trim("text") != "")


def chat(source: Column, target: Column, system: str, template: str = "{}") -> Column:
    """A record of system, user and assistant messages."""
    before, after = template.split("{}")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", F.concat(F.lit(before), source, F.lit(after))), said("assistant", target))


def training_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def longest(df: DataFrame, words: Column) -> DataFrame:
    return df.agg(F.max(F.size(words)).cast("long").alias("longest"))


def paraphrases(df: DataFrame, generate, text: str = "full_sentence", n: int = 1, tries: int = 5) -> DataFrame:
    """A row with ``paraphrase`` for each of up to ``n`` paraphrases of a text.

    ``generate`` is a column function (text) -> array of candidates in the
    order they are drawn: the boundary to a model. A candidate, trimmed, is
    taken if it isn't empty, nor the text, nor one taken before, nor
    degenerate. After ``tries`` candidates in a row that aren't, or when there
    are no more, the text has no further paraphrase. A null text has none.
    """
    own = F.trim(F.col(text))
    c = F.transform(generate(F.col(text)), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rated = F.arrays_zip(c.alias("x"), X.degenerate_flags(c).alias("bad"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("missed"))

    def step(state: Column, r: Column) -> Column:
        open_ = (state["missed"] < tries) & (F.size(state["taken"]) < n)
        good = ~r["bad"] & (r["x"] != "") & (r["x"] != own) & ~F.array_contains(state["taken"], r["x"])
        taken = F.when(open_ & good, F.array_append(state["taken"], r["x"])).otherwise(state["taken"])
        missed = F.when(open_ & good, 0).when(open_, state["missed"] + 1).otherwise(state["missed"])
        return F.struct(taken.alias("taken"), missed.alias("missed"))

    found = df.withColumn("rated_", rated).where(F.col(text).isNotNull())
    return found.withColumn("paraphrase", F.explode(F.aggregate("rated_", start, step)["taken"])).drop("rated_")
