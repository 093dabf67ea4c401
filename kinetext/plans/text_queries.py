"""Queries of corpus statistics, cleaning, matching, scoring and scraping, over documents, conversations, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import joins as J
from ..operators import matching, scoring
from ..operators import timing as M
from ..operators.terms import term_positions as terms_at
from ..sources import html
from .common import Registry, long, r6, spread, table

R = Registry()
add = R.add

W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')"
PUNCT = r"'[!-/:-@\[-`{-~]'"
WN = f"list_filter(list_transform({W}, lambda x: lower(regexp_replace(x, {PUNCT}, '', 'g'))), lambda x: x <> '')"
RAW, NORM = f"w AS (SELECT doc_id, {W} AS w FROM documents)", f"w AS (SELECT doc_id, {WN} AS w FROM documents)"
TOK = "t AS (SELECT unnest(w) AS token FROM w), c AS (SELECT token, count(*) AS count FROM t GROUP BY token)"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@add(f"WITH {RAW} SELECT CAST(len(w) AS INTEGER) AS length, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM w), 6) AS percentage FROM w GROUP BY len(w)")
def sentence_lengths(spark, sf_dir):
    return C.length_histogram(docs(spark, sf_dir), X.words("text")).withColumn("percentage", r6("percentage"))


@add(f"WITH {RAW}, n AS (SELECT CAST(len(w) AS DOUBLE) AS n FROM w) SELECT count(*) AS count, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_samp(n), 6) AS std, CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max FROM n")
def length_stats(spark, sf_dir):
    out = C.length_statistics(docs(spark, sf_dir), X.words("text"))
    return out.select("count", r6("mean").alias("mean"), r6("median").alias("median"), r6("std").alias("std"), "min", "max")


@add(f"WITH {RAW}, n AS (SELECT doc_id, len(w) AS n FROM w), e AS (SELECT 'shortest' AS kind, min(n) AS length FROM n UNION ALL SELECT 'longest', max(n) FROM n) SELECT kind, CAST(length AS BIGINT) AS length, count(*) AS texts, min(n.doc_id) AS first_id, arg_min(text, n.doc_id) AS example FROM e JOIN n ON n.n = e.length JOIN documents d ON d.doc_id = n.doc_id GROUP BY kind, length")
def extreme_examples(spark, sf_dir):
    return C.extreme_examples(docs(spark, sf_dir), X.words("text"), "text", "doc_id")


FREQ = f"{TOK} SELECT token, count, round(count * 100.0 / (SELECT sum(count) FROM c), 6) AS percentage FROM c"


@add(f"WITH {RAW}, {FREQ}")
def word_freq_raw(spark, sf_dir):
    return C.frequencies(C.tokens(docs(spark, sf_dir), X.words("text"))).withColumn("percentage", r6("percentage"))


@add(f"WITH {NORM}, {FREQ}")
def word_freq_norm(spark, sf_dir):
    return C.frequencies(C.tokens(docs(spark, sf_dir), X.normalized_words("text"))).withColumn("percentage", r6("percentage"))


@add(f"WITH {NORM}, {TOK} SELECT token, count FROM c ORDER BY count DESC, token LIMIT 10")
def top10_words(spark, sf_dir):
    return M.extremes(C.frequencies(C.tokens(docs(spark, sf_dir), X.normalized_words("text"))), "count", 10, ties=["token"]).select("token", "count")


@add(f"SELECT count(DISTINCT text) AS texts, (SELECT count(DISTINCT token) FROM (SELECT unnest({W}) AS token FROM documents)) AS words FROM documents")
def unique_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.agg(F.countDistinct("text").alias("texts")).crossJoin(C.tokens(d, X.words("text")).agg(F.countDistinct("token").alias("words")))


def _ngram(n, norm):
    w = NORM if norm else RAW
    grams = " || ' ' || ".join(f"lead(t, {i}) OVER (ORDER BY doc_id, p)" if i else "t" for i in range(n))
    return f"WITH {w}, s AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM w), g AS (SELECT {grams} AS ngram FROM s), c AS (SELECT ngram, count(*) AS count FROM g WHERE ngram IS NOT NULL GROUP BY ngram) SELECT ngram, count, round(count * 100.0 / (SELECT count(*) FROM s), 6) AS percentage FROM c"


def _add_ngram(n: int, norm: bool) -> None:
    def query(spark, sf_dir):
        text = X.normalized("text") if norm else F.col("text")
        return C.ngrams(docs(spark, sf_dir), text, n, "doc_id").withColumn("percentage", r6("percentage"))

    query.__name__ = f"ngram_{n}" + "_norm" * norm
    add(_ngram(n, norm))(query)


for _n in (1, 2, 3, 4):
    _add_ngram(_n, False)
_add_ngram(2, True)


@add(f"WITH {NORM}, {TOK} SELECT CAST(sum(count) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (count = 1) AS hapax, (SELECT round(avg(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END), 6) FROM w) AS mean_ttr, round(count(*) / sqrt(sum(count)), 6) AS guiraud FROM c")
def lexical_diversity(spark, sf_dir):
    out = C.diversity(docs(spark, sf_dir), X.normalized_words("text"))
    return out.select("tokens", "types", "hapax", r6("mean_ttr").alias("mean_ttr"), r6("guiraud").alias("guiraud"))


@add(f"""WITH {NORM}, {TOK}, m AS (SELECT ceil(avg(count)) AS a, median(count) AS d FROM c),
r AS (SELECT count(*) FILTER (count > 1000) b0, count(*) FILTER (count BETWEEN 100 AND 1000) b1, count(*) FILTER (count < 100) b2, count(*) FILTER (count <= a) b3, count(*) FILTER (count <= d) b4, count(*) FILTER (count <= 10) b5, count(*) FILTER (count <= 2) b6, count(*) FILTER (count = 1) b7 FROM c, m)
SELECT unnest(['>1000', '100-1000', '<100', '<=average_occurrence', '<=median_occurrence', '<=10', '<=2', '==1']) AS bucket, unnest([b0, b1, b2, b3, b4, b5, b6, b7]) AS items FROM r""")
def freq_buckets(spark, sf_dir):
    return C.frequency_buckets(C.frequencies(C.tokens(docs(spark, sf_dir), X.normalized_words("text"))))


@add(f"WITH {NORM}, {TOK}, q AS (SELECT quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS m, quantile_cont(count, 0.75) AS q3, min(count) AS lo, max(count) AS hi FROM c) SELECT round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS low_whisker, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS high_whisker FROM q")
def boxplot_stats(spark, sf_dir):
    out = C.box_plot(C.frequencies(C.tokens(docs(spark, sf_dir), X.normalized_words("text"))), "count")
    return out.select(*(r6(c).alias(c) for c in out.columns))


@add(f"WITH n AS (SELECT lang, len({W}) AS length FROM documents), c AS (SELECT lang, length, count(*) AS count FROM n GROUP BY ALL) SELECT CAST(a.length AS INTEGER) AS length, b.lang, coalesce(c.count, 0) AS count FROM (SELECT DISTINCT length FROM c) a CROSS JOIN (SELECT DISTINCT lang FROM c) b LEFT JOIN c ON c.length = a.length AND c.lang = b.lang")
def length_zero_fill_by_lang(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy(F.size(X.words("text")).alias("length"), "lang").agg(F.count(F.lit(1)).alias("count"))
    return J.zero_fill_grid(counts, "length", "lang", "count").select("length", "lang", "count")


@add("WITH c AS (SELECT lang, count(*) * 100.0 / (SELECT count(*) FROM documents) AS pct FROM documents GROUP BY lang) SELECT lang, CAST(round_even(pct / 100 * 500, 0) AS INTEGER) AS items FROM c")
def percent_to_counts(spark, sf_dir):
    shares = C.with_share(docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("count")))
    return shares.select("lang", C.percent_to_count(F.col("percentage"), 500).alias("items"))


@add("WITH s AS (SELECT 1 AS stage, sum(n_chars) AS size FROM documents UNION ALL SELECT 2, sum(n_chars) FROM documents WHERE lang = 'en' UNION ALL SELECT 3, sum(n_chars) FROM documents WHERE lang = 'en' AND n_chars < 1000) SELECT CAST(stage AS INTEGER) AS stage, CAST(size AS BIGINT) AS size, round(size * 100.0 / (SELECT size FROM s WHERE stage = 1), 6) AS percent FROM s")
def size_reduction(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    en = F.col("lang") == "en"
    row = d.agg(*(F.sum(F.when(c, F.col("n_chars"))).alias(f"s{i}") for i, c in enumerate((F.lit(True), en, en & (F.col("n_chars") < 1000)), 1)))
    stages = row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.col(f"s{i}").alias("size")) for i in (1, 2, 3)))).alias("x")).select("x.*")
    return C.reduction(stages, "size", "stage").withColumn("percent", r6("percent"))


@add(f"""WITH {RAW}, l AS (SELECT doc_id, len(w) AS n, unnest(range(1, least(10, len(w)) + 1)) AS k, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM l)), c AS (SELECT doc_id, n, k, g, count(*) AS f FROM g GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM c WHERE f > 1 AND f * k / n > 0.5) SELECT w.doc_id, bad.doc_id IS NOT NULL AS degenerate FROM w LEFT JOIN bad USING (doc_id)""")
def degenerate_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.is_degenerate("text").alias("degenerate"))


@add("WITH l AS (SELECT doc_id, 'A: |' || text || '*^||' AS line FROM documents) SELECT doc_id, regexp_replace(trim(translate(line, '*^', ''), '|'), '^(A:|B:)\\s*\\|+(.*)', '\\1 \\2') AS cleaned FROM l")
def clean_line(spark, sf_dir):
    line = F.concat(F.lit("A: |"), "text", F.lit("*^||"))
    return docs(spark, sf_dir).select("doc_id", X.clean_line(line).alias("cleaned"))


@add("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, 'A: ' || unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT *, rtrim(replace(replace(line, '„', ''), '“', ''), '/') AS t FROM l) SELECT doc_id, CAST(i AS INTEGER) AS i, length(t) > 4 AND regexp_matches(t, '^(?:A:|B:|C:)\\s*(?:[A-ZÄÖÜ].*|(?:[0-9#]\\S*(?:\\s+\\S+)+))$') AS is_sentence FROM b")
def sentence_classifier(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", X.is_sentence(F.concat(F.lit("A: "), "line")).alias("is_sentence"))


@add("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text))")
def substring_semi_join(spark, sf_dir):
    return J.contains_any(docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("text").alias("item")), "text", "item", strip="").where("found").select("doc_id")


@add("SELECT d.doc_id, t.term FROM documents d JOIN (VALUES ('the the'), ('password'), ('idiot'), ('ß')) t(term) ON contains(d.text, t.term)")
def term_search(spark, sf_dir):
    terms = spark.createDataFrame([("the the",), ("password",), ("idiot",), ("ß",)], "term string")
    return J.term_search(docs(spark, sf_dir), terms).select("doc_id", "term")


@add("""WITH RECURSIVE w AS (SELECT string_split(text, ' ') AS w FROM benchmark), t AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
r AS (SELECT doc_id, term, instr(text, term) AS p FROM documents JOIN t ON contains(text, term)
      UNION ALL SELECT r.doc_id, term, p + instr(substr(text, p + 1), term) FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE contains(substr(text, p + 1), term))
SELECT doc_id, term, p - 1 AS start FROM r""")
def term_positions(spark, sf_dir):
    """All places in documents where two words stand as they do in a benchmark item."""
    w = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
    terms = table(spark, sf_dir, "benchmark").where(F.size(w) > 1).select(F.explode(pairs).alias("term"))
    return terms_at(spread(docs(spark, sf_dir).select("doc_id", "text")), terms, ["doc_id"])


@add("""SELECT conv_id, turn FROM conversations c WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents h WHERE trim(h.text) = trim(c.text)) AND NOT EXISTS (SELECT 1 FROM benchmark h WHERE trim(h.text) = trim(c.text))
UNION ALL SELECT -doc_id, 0 FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations h WHERE trim(h.text) = trim(d.text)) AND NOT EXISTS (SELECT 1 FROM documents h JOIN labels l ON h.doc_id = l.doc_id WHERE h.doc_id <> d.doc_id AND trim(h.text) = trim(d.text) AND trim(h.lang) = trim(d.lang)) AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def leak_filter(spark, sf_dir):
    """Turns that neither a document nor a benchmark item has; and documents without labels, less those with the text of a turn, or the text and language of a labelled document."""
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    c = table(spark, sf_dir, "conversations")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    turns = C.without_leaks(c, [d, b], ["text"]).select("conv_id", "turn")
    train = C.without_leaks(d.join(labels, "doc_id", "left_anti"), [c], ["text"])
    train = C.without_leaks(train, [d.join(labels, "doc_id", "left_semi")], ["text", "lang"])
    return turns.unionByName(train.select((-F.col("doc_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn")))


@add("SELECT DISTINCT doc_id AS gloss FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_keys(spark, sf_dir):
    wanted = docs(spark, sf_dir).select(F.col("doc_id").alias("gloss"))
    return D.missing_glosses(wanted, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("gloss")))


SEEDS = (101, 202, 303)


@add(f"WITH s AS (SELECT unnest({list(SEEDS)}) AS seed), r AS (SELECT doc_id, seed, row_number() OVER (PARTITION BY seed ORDER BY (doc_id * (2654435761 + 2 * seed)) % 4294967296, doc_id) AS n, count(*) OVER (PARTITION BY seed) AS c FROM documents, s), k AS (SELECT *, CAST(ceil(c * 0.2) AS BIGINT) AS h FROM r) SELECT doc_id, CAST(seed AS INTEGER) AS seed, CASE WHEN n <= (h + 1) // 2 THEN 'test' WHEN n <= h THEN 'dev' ELSE 'train' END AS part FROM k")
def split_80_10_10(spark, sf_dir):
    mix = lambda seed: F.pmod(F.col("doc_id") * F.lit(2654435761 + 2 * seed), F.lit(4294967296))
    return C.split_train_test(docs(spark, sf_dir).select("doc_id"), ["doc_id"], seeds=SEEDS, mix=mix)


@add("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")
def union_all_corpus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'user'").unionByName(c.where("role = 'assistant'")).select("conv_id", "turn", "text")


@add("SELECT unnest([role, text]) AS text FROM conversations")
def text_corpus_unpivot(spark, sf_dir):
    return C.column_union(table(spark, sf_dir, "conversations"), "role", "text")


@add("""WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sid FROM conversations)
SELECT conv_id, CAST(sid AS BIGINT) AS sid, max(text) FILTER (role = 'user') AS full_sentence, string_agg(text, ',' ORDER BY turn) FILTER (role = 'assistant') AS glosses FROM c WHERE sid > 0 GROUP BY conv_id, sid HAVING count(*) FILTER (role = 'assistant') > 0""")
def sentence_gloss_pairs(spark, sf_dir):
    from ..operators import segments as S

    c = table(spark, sf_dir, "conversations").withColumns({"is_full": F.col("role") == "user", "start_ms": F.col("turn"), "end_ms": F.lit(1 << 40)})
    # A user's turn opens a sentence; its last reply ends it.
    marked = S.mark_sentences(c.where("role <> 'system'"), ["conv_id"], "turn")
    return S.sentence_pairs(marked, ["conv_id"], "turn", strict=True).select("conv_id", long("sid").alias("sid"), "full_sentence", "glosses")


@add("SELECT conv_id, turn, '<|system|>' || chr(10) || 'Translate.' || chr(10) || '<|user|>' || chr(10) || 'Text: ' || role || chr(10) || '<|assistant|>' || chr(10) || text AS record FROM conversations")
def chat_format(spark, sf_dir):
    record = C.training_text(C.chat(F.col("role"), F.col("text"), "Translate.", "Text: {}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("record"))


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("pred"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("ref"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "pred", "ref")


PAIRS = "pr AS (SELECT u.conv_id * 10000 + a.turn AS id, u.text AS pred, a.text AS ref FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
PW, RW = W.replace("text", "pred"), W.replace("text", "ref")


def _grams(source, side, flag, orders):
    return f"SELECT id, k AS n, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, {flag} AS p FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT id, {source} AS w, unnest(range(1, {orders + 1})) AS k FROM pr) WHERE len(w) >= k)"


def _counts(p, r):
    return f"x AS ({_grams(p, 'pred', 1, 4)} UNION ALL {_grams(r, 'ref', 0, 4)}), c AS (SELECT id, n, g, sum(p) AS p, sum(1 - p) AS r FROM x GROUP BY ALL), m AS (SELECT n, sum(p) AS pred, sum(r) AS ref, sum(least(p, r)) AS matches FROM c GROUP BY n)"


@add(f"WITH {PAIRS}, {_counts(PW, RW)} SELECT CAST(n AS INTEGER) AS n, CAST(pred AS BIGINT) AS pred, CAST(ref AS BIGINT) AS ref, CAST(matches AS BIGINT) AS matches FROM m")
def gram_matches(spark, sf_dir):
    p = pairs(spark, sf_dir).select("id", X.words("pred").alias("pred"), X.words("ref").alias("ref"))
    return scoring.gram_matches(p, range(1, 5))


def _tokens_13a(side: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"coalesce({side}, '')"
    for old, new in scoring.ENTITIES:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    out = f"' ' || {out} || ' '"
    for rule, new in scoring.PARTED:
        out = f"regexp_replace({out}, {quoted(rule)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda x: x <> '')"


P13, R13 = _tokens_13a("pred"), _tokens_13a("ref")


@add(f"""WITH {PAIRS}, {_counts(P13, R13)}, l AS (SELECT sum(len({P13})) AS c, sum(len({R13})) AS r FROM pr), bp AS (SELECT CASE WHEN c < r THEN exp(1 - r / c) ELSE 1 END AS b FROM l),
pn AS (SELECT n, CASE WHEN matches > 0 THEN matches ELSE pow(0.5, sum(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n)) END / pred AS p FROM m) SELECT """ + ", ".join(f"round(100 * (SELECT b FROM bp) * (SELECT exp(sum(ln(p)) / {k}) FROM pn WHERE n <= {k}), 6) AS bleu_{k}" for k in (1, 2, 3, 4)))
def bleu(spark, sf_dir):
    out = scoring.bleu(pairs(spark, sf_dir))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def _chars(side, flag):
    bare = f"regexp_replace({side}, '\\s+', '', 'g')"
    return f"SELECT id, k AS n, substr(s, i, k) AS g, {flag} AS p FROM (SELECT id, s, k, unnest(range(1, length(s) - k + 2)) AS i FROM (SELECT id, {bare} AS s, unnest(range(1, 7)) AS k FROM pr) WHERE length(s) >= k)"


@add(f"WITH {PAIRS}, x AS ({_chars('pred', 1)} UNION ALL {_chars('ref', 0)}), c AS (SELECT id, n, g, sum(p) AS p, sum(1 - p) AS r FROM x GROUP BY ALL), m AS (SELECT n, sum(p) AS pred, sum(r) AS ref, sum(least(p, r)) AS matches FROM c GROUP BY n), a AS (SELECT avg(matches / pred) AS p, avg(matches / ref) AS r FROM m WHERE pred > 0 AND ref > 0) SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM a")
def chrf(spark, sf_dir):
    return scoring.chrf(pairs(spark, sf_dir)).select(r6("chrf").alias("chrf"))


RP, RR = (f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')" for c in ("pred", "ref"))
#: A table row by row: the longest common subsequence, and the edits, of the first i words of a with the first j of b. Ranges start before the first word.
LCS = "SELECT id, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda k: greatest(t[k + 1], t[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END))) END) FROM {0} WHERE i < len(a)"
EDITS = "SELECT id, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: least(i + 1 + j, coalesce(list_min(list_transform(range(1, j + 1), lambda k: least(t[k + 1] + 1, t[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END) + j - k)), i + 1 + j))) FROM {0} WHERE i < len(a)"


@add(f"""WITH RECURSIVE {PAIRS}, w AS (SELECT id, {RP} AS a, {RR} AS b FROM pr), g AS ({_grams(RP, 'pred', 1, 2)} UNION ALL {_grams(RR, 'ref', 0, 2)}), c AS (SELECT id, n, g, sum(p) AS p, sum(1 - p) AS r FROM g GROUP BY ALL), m AS (SELECT id, n, 2.0 * sum(least(p, r)) / (sum(p) + sum(r)) AS f FROM c GROUP BY id, n),
l AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS t FROM w UNION ALL {LCS.format("l")}), e AS (SELECT id, coalesce(2.0 * t[len(b) + 1] / nullif(len(a) + len(b), 0), 0) AS f FROM l WHERE i = len(a))
SELECT round(100 * avg(coalesce(m1.f, 0)), 6) AS rouge_1, round(100 * avg(coalesce(m2.f, 0)), 6) AS rouge_2, round(100 * avg(e.f), 6) AS rouge_l FROM e LEFT JOIN m m1 ON m1.id = e.id AND m1.n = 1 LEFT JOIN m m2 ON m2.id = e.id AND m2.n = 2""")
def rouge_unstemmed(spark, sf_dir):
    out = scoring.rouge(pairs(spark, sf_dir), stemmed=False)
    return out.select(*(r6(c).alias(c) for c in out.columns))


@add()
def rouge(spark, sf_dir):
    """With Porter's stems, which SQL cannot express."""
    out = scoring.rouge(pairs(spark, sf_dir))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@add(f"""WITH RECURSIVE {PAIRS}, w AS (SELECT id, {PW} AS a, {RW} AS b FROM pr), l AS (SELECT id, a, b, 0 AS i, range(len(b) + 1) AS t FROM w UNION ALL {EDITS.format("l")})
SELECT round(sum(t[len(b) + 1]) / sum(len(b)), 6) AS wer FROM l WHERE i = len(a)""")
def wer(spark, sf_dir):
    return scoring.wer(pairs(spark, sf_dir)).select(r6("wer").alias("wer"))


@add(f"""WITH RECURSIVE {PAIRS}, w AS (SELECT id, {PW.replace("pred", "lower(pred)")} AS a, {RW.replace("ref", "lower(ref)")} AS b FROM pr), l AS (SELECT id, a, b, 0 AS i, range(len(b) + 1) AS t FROM w UNION ALL {EDITS.format("l")})
SELECT round(100 * sum(t[len(b) + 1]) / sum(len(b)), 6) AS ter FROM l WHERE i = len(a)""")
def ter_unshifted(spark, sf_dir):
    """What the translation edit rate is without shifts and without a band."""
    return scoring.ter(pairs(spark, sf_dir), shift=False, beam=None).select(r6("ter").alias("ter"))


@add()
def ter(spark, sf_dir):
    """Greedy block shifts are beyond SQL."""
    return scoring.ter(pairs(spark, sf_dir)).select(r6("ter").alias("ter"))


@add(f"SELECT max(len({W})) AS longest FROM conversations")
def longest_text(spark, sf_dir):
    return C.longest(table(spark, sf_dir, "conversations"), X.words("text"))


HREF = r"""'(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""


@add(f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, {HREF}, 1)) AS href, unnest(regexp_extract_all(html, {HREF}, 2)) AS body, unnest(range(len(regexp_extract_all(html, {HREF}, 1)))) AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim(regexp_replace(body, '<[^>]*>', '', 'g')) AS text, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href END AS target FROM l WHERE starts_with(href, '/') OR regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')""")
def link_scrape(spark, sf_dir):
    found = html.links(table(spark, sf_dir, "pages"))
    return found.where(F.col("href").startswith("/") | F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"))


PARA = r"'(?is)<p\b[^>]*>(.*?)</p>'"


@add(f"""WITH p AS (SELECT unnest(regexp_extract_all(html, {PARA}, 1)) AS p FROM pages), g AS (SELECT regexp_extract(trim(regexp_replace(p, '<[^>]*>', '', 'g')), '^([^\\s(]+)', 1) AS gloss FROM p UNION ALL SELECT trim(regexp_replace(regexp_extract(p, {HREF}, 2), '<[^>]*>', '', 'g')) FROM p) SELECT DISTINCT gloss FROM g WHERE gloss <> ''""")
def paragraph_terms(spark, sf_dir):
    return html.paragraph_terms(table(spark, sf_dir, "pages"))


@add("WITH r AS (SELECT nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, nullif(regexp_extract(url, '[?](.*)$', 1), '') AS query FROM pages) SELECT count(*) FILTER (title IS NULL) AS no_title, count(*) FILTER (query IS NULL) AS no_query, count(*) FILTER (title IS NULL AND query IS NULL) AS neither, count(*) FILTER (title IS NULL OR query IS NULL) AS incomplete FROM r")
def missing_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.nullif(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract("url", "[?](.*)$", 1), F.lit("")).alias("query"))
    return D.missing_links(rows, "title", "query")


@add("WITH t AS (SELECT page_id, regexp_replace(strip_accents(regexp_extract(html, '<title>([^<]*)', 1)), '[^\\x00-\\x7F]', '', 'g') AS t FROM pages) SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'untitled') AS name FROM t")
def filename_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("name"))


GLOSSES = "g AS (SELECT row_number() OVER (ORDER BY gloss) AS idx, gloss FROM (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS gloss FROM part))"


def glosses(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("gloss")).distinct()  # a few dozen brands
    return names.withColumn("idx", F.row_number().over(Window.orderBy("gloss")))


@add(f"""WITH {GLOSSES}, q AS (SELECT DISTINCT upper(split_part(p_brand, '#', 1)) AS q FROM part UNION SELECT 'BRAND99X' UNION SELECT 'OTHER'), v AS (SELECT gloss, regexp_extract(gloss, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 1) AS base, CAST(nullif(regexp_extract(gloss, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 2), '') AS INTEGER) AS num FROM g)
SELECT q, (SELECT arg_min(gloss, coalesce(num, 0)) FROM v WHERE v.base = regexp_extract(q, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 1) AND v.base <> '') AS match FROM q""")
def variant_match(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.upper(F.split_part("p_brand", F.lit("#"), F.lit(1))).alias("q")).distinct().unionByName(spark.createDataFrame([("BRAND99X",), ("OTHER",)], "q string"))
    return matching.variant_match(q, glosses(spark, sf_dir)).select("q", "match")


def _ratios(asked: str, known: str) -> str:
    """Ratios of all pairs of q and gloss that share a letter."""
    return f"""z AS (SELECT row_number() OVER () AS id, q, gloss, idx, string_split(q, '') AS a, string_split(gloss, '') AS b FROM {asked}, {known} WHERE q <> '' AND gloss <> ''),
l AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS t FROM z UNION ALL {LCS.format("l")}), rt AS (SELECT q, gloss, idx, 200.0 * t[len(l.b) + 1] / (len(l.a) + len(l.b)) AS ratio FROM l JOIN z ON l.id = z.id WHERE i = len(l.a)),
fz AS (SELECT q, arg_max(gloss, struct_pack(r := ratio, o := -idx)) AS match, max(ratio) AS ratio FROM rt WHERE ratio >= 80 GROUP BY q)"""


@add(f"""WITH RECURSIVE n AS (SELECT DISTINCT upper(p_name) AS gloss FROM part), g AS (SELECT gloss, row_number() OVER (ORDER BY gloss) AS idx FROM n), s AS (SELECT DISTINCT regexp_replace(gloss, '[AEI]$|L', '', 'g') AS q FROM n), {_ratios('s', 'g')}
SELECT s.q, match, round(ratio, 6) AS ratio FROM s LEFT JOIN fz ON s.q = fz.q""")
def fuzzy_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.upper("p_name").alias("gloss")).distinct()
    asked = names.select(F.regexp_replace("gloss", "[AEI]$|L", "").alias("q")).distinct()
    known = J.running(names, F.lit(1), ["gloss"], "before_").select("gloss", (F.col("before_") + 1).alias("idx"))
    return matching.fuzzy_match(asked, known).select("q", "match", r6("ratio").alias("ratio"))


ASKED = "CASE p_partkey % 4 WHEN 0 THEN replace(p_brand, '#', '') WHEN 1 THEN 'brand' WHEN 2 THEN replace(p_brand, '#', '-') || '!' ELSE 'x' || p_name END"
VECTOR_OF = "list_transform(range(8), lambda i: CAST(CAST(('0x' || substr(md5({0}), 4 * i + 1, 4)) AS INTEGER) AS DOUBLE))"


@add(f"""WITH RECURSIVE {GLOSSES}, u AS (SELECT DISTINCT upper({ASKED}) AS q FROM part), ex AS (SELECT q FROM u JOIN g ON g.gloss = u.q), u1 AS (SELECT q FROM u WHERE q NOT IN (SELECT q FROM ex)),
v AS (SELECT gloss, regexp_extract(gloss, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 1) AS base, CAST(coalesce(nullif(regexp_extract(gloss, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 2), ''), '0') AS INTEGER) AS num FROM g),
va AS (SELECT q, (SELECT arg_min(gloss, num) FROM v WHERE v.base = regexp_extract(q, '^([A-ZÄÖÜ]+)([0-9]+)?([A-Z]*)$', 1) AND v.base <> '') AS match FROM u1), u2 AS (SELECT q FROM va WHERE match IS NULL), {_ratios('u2', 'g')},
u3 AS (SELECT q FROM u2 WHERE q NOT IN (SELECT q FROM fz)), ne AS (SELECT u3.q, arg_max(gloss, list_cosine_similarity({VECTOR_OF.format("u3.q")}, {VECTOR_OF.format("gloss")})) AS match FROM u3, g GROUP BY u3.q),
found AS (SELECT q, q AS match, 'exact' AS stage FROM ex UNION ALL SELECT q, match, 'variant' FROM va WHERE match IS NOT NULL UNION ALL SELECT q, match, 'fuzzy' FROM fz UNION ALL SELECT q, match, 'nearest' FROM ne)
SELECT p_partkey, upper({ASKED}) AS q, match, stage FROM part JOIN found ON found.q = upper({ASKED})""")
def cascade_match(spark, sf_dir):
    """The vectors stand for those of a model: 16 bits of a hash to a component."""
    bare = F.replace("p_brand", F.lit("#"), F.lit(""))
    no = F.col("p_partkey") % 4
    asked = table(spark, sf_dir, "part").select("p_partkey", F.when(no == 0, bare).when(no == 1, F.lit("brand")).when(no == 2, F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("!"))).otherwise(F.concat(F.lit("x"), "p_name")).alias("q"))
    embed = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(F.md5(c), 4 * i + 1, F.lit(4)), 16, 10).cast("double"))
    known = glosses(spark, sf_dir)
    return matching.cascade(asked, known, embed=embed).select("p_partkey", "q", "match", "stage")


@add("WITH t AS (SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) SELECT c_custkey, CAST(coalesce(n, 0) AS DOUBLE) AS median_igt, round(coalesce(total, 0), 2) AS median_ogt FROM customer LEFT JOIN t ON c_custkey = o_custkey")
def left_join_fill0(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("gloss")).agg(F.count(F.lit(1)).cast("double").alias("median_igt"), F.sum("o_totalprice").alias("median_ogt"))
    out = M.fill_times(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gloss")), t, ["median_igt", "median_ogt"])
    return out.select(F.col("gloss").alias("c_custkey"), "median_igt", F.round("median_ogt", 2).alias("median_ogt"))


@add("WITH r AS (SELECT array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), ',') AS g FROM documents), s AS (SELECT string_split(g, ',') AS a FROM r) SELECT count(*) FILTER (starts_with(a[1], 'The')) AS first_0, count(*) FILTER (len(list_filter(a, lambda x: starts_with(x, 'The'))) > 0) AS any_0, count(*) FILTER (starts_with(a[1], 'of')) AS first_1, count(*) FILTER (len(list_filter(a, lambda x: starts_with(x, 'of'))) > 0) AS any_1, count(*) FILTER (len(list_filter(a, lambda x: starts_with(x, 'The') OR starts_with(x, 'of'))) > 0) AS \"any\" FROM s")
def conditional_prefix_counts(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.array_join(X.words("text"), ",").alias("g"))
    return D.prefix_counts(rows, "g", ["The", "of"])


@add("SELECT CAST(sum(length(html)) AS BIGINT) AS bytes, CAST(sum(page_id) AS BIGINT) AS frames, (SELECT count(*) FROM events) AS glosses, (SELECT count(DISTINCT event_type) FROM events) AS unique_glosses, round(sum(length(html)) / 1073741824, 6) AS gib FROM pages")
def corpus_totals(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.length("html").alias("size"), F.col("page_id").alias("frames"))
    return D.corpus_totals(files, table(spark, sf_dir, "events").select(F.col("event_type").alias("gloss"))).withColumn("gib", r6("gib"))


@add("SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def sorted_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
