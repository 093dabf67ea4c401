"""Language identification by Bayesian evidence fusion.

For each document and language, the log likelihood of its letter trigrams is
added to that of the declared markup language, that of the address suffix, and
a host prior. The likelihoods of declaration and suffix, and the priors (host,
smoothed towards its suffix, smoothed towards the whole corpus), come from one
grouped aggregation over what the texts alone say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import features as X

#: Labelled documents of each language that the text model is fitted on, on average over hashes of ids (all if there are fewer), and languages that are scored at a time.
SAMPLE, LANGUAGES = 500, 64
#: Bytes of text whose trigrams are in memory at a time.
BLOCK = 1 << 20
#: Trigrams of a text are far from independent: their joint log likelihood counts as that of this many at most, and this share of them.
MOST_GRAMS, TEMPER = 200, 0.25
#: Pseudo-counts: of a host's parent, of the corpus for a suffix, and of an even spread for the corpus and for declarations.
HOST_WEIGHT, SUFFIX_WEIGHT, EVEN_WEIGHT = 20.0, 50.0, 1.0
#: A document is rejected if no language is at least this likely, or if its trigrams fit no language better than this (nats a trigram) over evenly spread ones.
LEAST_PROBABILITY, LEAST_GAIN = 0.5, 1.0
OTHER = "?"


class Grams:
    """Log probabilities of trigrams by language: those that occur, and what any other has. Dense for LANGUAGES at a time."""

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray, languages: int) -> None:
        order = np.argsort(lang, kind="stable")
        self.lang, self.code, self.languages = lang[order], code[order], languages
        log_total = np.log(np.bincount(lang, n, languages) + 0.5 * X.GRAMS)
        self.other = (np.log(0.5) - log_total).astype(np.float32)
        self.value = (np.log(n[order] + 0.5) - log_total[self.lang]).astype(np.float32)
        self.only: np.ndarray | None = None  # the block, if there is but one

    def block(self, first: int) -> np.ndarray:
        if self.only is not None:
            return self.only
        stop = min(first + LANGUAGES, self.languages)
        own = slice(*np.searchsorted(self.lang, (first, stop)))
        table = np.tile(self.other[first:stop], (X.GRAMS, 1))
        table[self.code[own], self.lang[own] - first] = self.value[own]
        if self.languages <= LANGUAGES:
            self.only = table
        return table

    def scores(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``text_scores`` over all languages."""
        found = [text_scores(data, at, self.block(i)) for i in range(0, self.languages, LANGUAGES)]
        return found[0][0], np.concatenate([mean for _, mean in found], 1)


def declaration(value: Column) -> Column:
    """A declared language as it is compared everywhere: lower-cased, without white space at its ends, null if nothing is left."""
    return F.nullif(F.lower(F.btrim(value.cast("string"), F.lit(" \t\n\x0b\f\r"))), F.lit(""))


def fit_text_model(labelled: DataFrame, text_col: str, label_col: str, id_col: str, sample: int = SAMPLE) -> tuple[list[str], Grams | None]:
    """(all declared languages, log probability of each trigram in each): counted on the workers over about ``sample`` documents a language.

    Labels that differ in case or in white space at their ends are one. Rows
    with a null or empty label or a null text are left out; an empty text counts for its
    label with no trigrams. Rows that repeat each count. Without labels there
    are no languages and no model.
    """
    label, text, place = (C.free_name(labelled, x) for x in ("__label", "__body", "__place"))
    # A document is taken if its id's hash, even over 2^32, is below its language's share.
    known = labelled.select(declaration(F.col(f"`{label_col}`")).alias(label), F.col(f"`{text_col}`").cast("string").alias(text), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 32)).alias(place))
    known = known.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    languages = sorted(r[label] for r in sizes)
    if not languages:
        return [], None
    number = {x: i for i, x in enumerate(languages)}
    shares = labelled.sparkSession.createDataFrame([(r[label], number[r[label]], min(1 << 32, (sample << 32) // r["n"])) for r in sizes], "name string, lang int, share long")
    chosen = known.join(C.sized_broadcast(shares, F.length("name") + 12), F.col(label) == F.col("name")).where(F.col(place) < F.col("share")).select("lang", F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            for part in C.slices(batch, "text", BLOCK):
                codes, row = X.trigrams(*C.view(part.column("text")))
                found, n = np.unique(np.asarray(part.column("lang"))[row].astype(np.int64) * X.GRAMS + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found // X.GRAMS).astype(np.int32)), pa.array((found % X.GRAMS).astype(np.int32)), pa.array(n)], names=["lang", "code", "n"])

    got = chosen.mapInArrow(count, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()  # trigrams that occur, of each language
    return languages, Grams(*(np.asarray(got.column(x).combine_chunks()) for x in ("lang", "code", "n")), len(languages))


def text_scores(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of trigrams, mean log probability in each language) of each row."""
    rows, langs = len(at) - 1, table.shape[1]
    n, total = np.zeros(rows, np.int64), np.zeros((rows, langs))
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        for begin in range(int(at[lo]), int(at[hi]), BLOCK) if hi == lo + 1 else [int(at[lo])]:
            end = min(begin + BLOCK + 2, int(at[hi])) if hi == lo + 1 else int(at[hi])
            codes, row = X.trigrams(data[begin:end], np.clip(at[lo : hi + 1] - begin, 0, end - begin))
            n[lo:hi] += np.bincount(row, minlength=hi - lo)
            found = table[codes]
            for i in range(langs):
                total[lo:hi, i] += np.bincount(row, weights=found[:, i], minlength=hi - lo)
        lo = hi
    return n, total / np.maximum(n, 1)[:, None]


def host_and_suffix(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, with A-Z lower-cased, without user and port, and what follows its last dot; null where there is none (also for a null URL)."""
    host = F.regexp_extract(C.lower_az(url), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(host, F.lit("")), F.nullif(F.substring_index(host, ".", -1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The primary language that the first html element with a lang declares, wherever it stands; null without one, or for null or empty html."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags; null for null. A tag, comment or script that is never closed stays as text."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")


def identify(docs: DataFrame, model: tuple[list[str], Grams | None], text_col: str = "text", declared_col: str | None = None, host_col: str | None = None, suffix_col: str | None = None, least: float = LEAST_PROBABILITY, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``language`` (the most likely; ties to the first by name), ``probability``, ``text_language`` and ``accepted``.

    Evidence that is null, or whose column isn't given, says nothing. Text
    without letters (also null or empty) leaves prior, declaration and suffix
    to decide but is rejected. Without languages in the model every row gets
    null and is rejected. Columns of ``docs`` named like a new one are
    replaced. Repeated rows each count and each get their result.
    """
    languages, table = model
    new = ["language", "probability", "text_language", "accepted"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    if not languages:
        return docs.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "text_language": F.lit(None).cast("string"), "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(table)  # trigrams that occur, of each language
    L = len(languages)
    some = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    names = {x: C.free_name(docs, "__" + x) for x in ("declared", "suffix", "host", "prior", "told", "hk", "hs", "declaredk", "declaredp", "suffixk", "suffixp", "grams", "best", "mean")}
    declared, suffix, host, prior, told, hk, hs, dk, dp, sk, sp, grams, best, mean_of = names.values()
    docs = C.as_text(docs, text_col)
    with_evidence = docs.withColumns({declared: declaration(some(declared_col)), suffix: some(suffix_col), host: some(host_col)})

    # What the texts alone say. They are read once; the rest works on the scores.
    def score(part: pa.RecordBatch) -> dict:
        count, mean = shared.value.scores(*C.view(part.column(text_col)))
        return {grams: pa.array(count), best: pa.array(np.where(count > 0, mean.argmax(1), -1).astype(np.int32)), mean_of: pa.array([x.tobytes() for x in mean], pa.binary())}

    fields = [T.StructField(grams, T.LongType()), T.StructField(best, T.IntegerType()), T.StructField(mean_of, T.BinaryType())]
    scored = C.materialize(C.add_columns(with_evidence, score, fields, text_col, drop=(text_col,) * drop_text, block=BLOCK), "scored")
    seen = scored.where(F.col(best) >= 0).groupBy(F.col(host).alias("host"), F.col(suffix).alias("suffix"), F.col(declared).alias("declared"), F.col(best).alias("best"))
    seen = C.materialize(seen.agg(F.count(F.lit(1)).alias("n")), "seen")

    def shares(keys: list[str]) -> DataFrame:
        """Counts of each language for each value of the keys, as an array."""
        counts = seen.groupBy(*keys, "best").agg(F.sum("n").cast("double").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("c"))
        return counts.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0.0))))

    total = [0.0] * L
    for r in seen.groupBy("best").agg(F.sum("n").cast("double").alias("n")).collect():  # a row for each language
        total[r["best"]] = r["n"]
    corpus = (np.array(total) + EVEN_WEIGHT) / (sum(total) + EVEN_WEIGHT * L)
    literal = lambda xs: F.expr(f"array({', '.join(f'{float(x)!r}D' for x in xs)})")
    smooth = lambda counts, parent, w: F.zip_with(counts, parent, lambda c, p: (c + p * w) / (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + w))
    by_suffix = shares(["suffix"]).where("suffix is not null").select(F.col("suffix").alias("s"), smooth(F.col("c"), literal(corpus), SUFFIX_WEIGHT).alias("sp"))
    hosts = shares(["host", "suffix"]).where("host is not null").join(by_suffix, F.col("suffix") == F.col("s"), "left")
    hosts = hosts.select(F.col("host").alias(hk), F.coalesce("suffix", F.lit("")).alias(hs), smooth(F.col("c"), F.coalesce("sp", literal(corpus)), HOST_WEIGHT).alias(prior))
    # How often each language declares each value, or has each suffix: p(value | language).
    def given(column: str) -> DataFrame:
        return shares([column]).where(f"{column} is not null").select(F.col(column).alias(names[column + "k"]), F.zip_with("c", literal(np.array(total) + EVEN_WEIGHT), lambda c, t: F.log((c + EVEN_WEIGHT * 0.05) / t)).alias(names[column + "p"]))

    out = scored
    for side, on in ((hosts, (F.col(host) == F.col(hk)) & (F.coalesce(F.col(suffix), F.lit("")) == F.col(hs))), (given("declared"), F.col(declared) == F.col(dk)), (given("suffix"), F.col(suffix) == F.col(sk))):
        out = out.join(C.sized_broadcast(C.materialize(side, "evidence"), F.lit(64 + 8 * L)), on, "left")
    zero = literal([0.0] * L)
    out = out.withColumn(told, F.zip_with(F.coalesce(dp, zero), F.coalesce(sp, zero), lambda a, b: a + b))
    out = out.withColumn(told, F.zip_with(told, F.transform(F.coalesce(prior, literal(corpus)), lambda x: F.log(x)), lambda a, b: a + b))
    out = out.drop(hk, hs, prior, dk, dp, sk, sp, declared, suffix, host)

    def fuse(part: pa.RecordBatch) -> dict:
        count, mean = np.asarray(part.column(grams)), C.view(part.column(mean_of))[0].copy().view(float).reshape(-1, L)
        extra = np.asarray(part.column(told).flatten()).reshape(-1, L)
        log = mean * (np.minimum(count, MOST_GRAMS) * TEMPER)[:, None] + extra
        p = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
        p /= p.sum(1, keepdims=True)
        best_ = p.argmax(1)
        sure = p[np.arange(len(p)), best_]
        gain = mean[np.arange(len(p)), best_] + np.log(X.GRAMS)
        names_ = np.array(languages, object)
        return {
            "language": pa.array(names_[best_], pa.string()), "probability": pa.array(sure, pa.float64()),
            "text_language": pa.array(np.where(count > 0, names_[mean.argmax(1)], None), pa.string()),
            "accepted": pa.array((count > 0) & (sure >= least) & (gain >= LEAST_GAIN)),
        }

    fields = [T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("text_language", T.StringType()), T.StructField("accepted", T.BooleanType())]
    return C.add_columns(out, fuse, fields, mean_of, drop=(told, grams, best, mean_of))


def identify_documents(docs: DataFrame, sample: int = SAMPLE, drop_text: bool = False) -> DataFrame:
    """Documents: ``lang`` is the declaration, ``source`` the host; the text model is fitted on a bounded sample of declared documents."""
    model = fit_text_model(docs, "text", "lang", "doc_id", sample)
    return identify(docs, model, "text", declared_col="lang", host_col="source", drop_text=drop_text)


def identify_pages(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Pages (page_id, url, html): language of the html element, suffix and host of the URL, and the visible text; fitted on documents of declared language.

    A null or odd URL gives no host and no suffix, null html no declaration
    and no text; such a page is judged by what it has, and rejected without
    text. Other columns of ``pages`` are left out. Repeated rows each get
    their result.
    """
    model = fit_text_model(docs, "text", "lang", "doc_id", sample)
    host, suffix = host_and_suffix(F.col("url"))
    ready = pages.select("page_id", "url", visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), host.alias("host"), suffix.alias("suffix"))
    return identify(ready, model, "text", "declared", "host", "suffix", drop_text=True)
