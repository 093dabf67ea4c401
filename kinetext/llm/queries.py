"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, language_id, license_scan, line_dedup, prefix_trie, quality, secret_scan, simhash, url_filter, vector_codes, warc

#: The vocabulary of op6; workers read it from the installed library.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents; an input of fewer splits than the cluster has cores is dealt out evenly first."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha(F.array_join("item_ids", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text", "lang", "source")
    return language_id.identify_documents(docs, drop_text=True).select("doc_id", "language", "probability", "text_language", "accepted")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op3 over pages, which declare a language and have an address."""
    found = language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "declared", "host", "suffix", "language", "probability", "text_language", "accepted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text", "source", "lang", "n_chars")
    found = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    keep = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return found.select("doc_id", F.col("p_quality").alias("quality_score"), F.col("p_toxic").alias("toxic_score"), keep.alias("keep"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(texts(spark, sf_dir, "doc_id", "text"))
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), sha(shown(base)).alias("base_sha256"), shown(F.col("findings")).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_and_decode(texts(spark, sf_dir, "doc_id", "text"), VOCABULARY, drop_text=True)
    return found.select("doc_id", "n_tokens", sha(F.col("ids_text")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "method_rule")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return license_scan.summarize(found).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs).drop("preorder", "subtree_end")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_benchmark_decontamination, op3_language_id, op4_quality, op5_secret_scan, op6_bpe, op7_url_filter, op8_simhash, op9_license_scan, op10_nearest_neighbours, op11_prefix_trie, op12_vector_codes, op13_warc_packages, page_language)
}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{az}", AZ)

def secrets_sql() -> str:
    """A match starts after the gaps and matches before it: the pieces that a split at matches leaves, and the matches, by turns."""
    either_case = lambda x: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", x)
    found = []
    for no, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        regex = re.sub(r"\(\?i:([^)]*)\)", lambda m: f"(?:{either_case(m[1])})", rule.regex.decode()).replace("'", "''")
        group, before = rule.group, re.fullmatch(r"\(\?<!\[(.*?)\]\)(.*)", regex)
        if before:  # DuckDB's expressions can't look behind: what stands before is matched too, and its length taken off
            regex, group = rf"(?:^|[^{before[1]}])({before[2]})", 1
        skip = "length(w) - length(p)" if before else "0"
        found.append(f"""SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, w, p, CAST(sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + {skip} AS a, {skip} AS skip, {rule.least} AS least
FROM (SELECT doc_id, unnest(w) AS w, unnest(p) AS p, unnest(g[1:len(w)]) AS g, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS w, regexp_extract_all(text, '{regex}', {group}) AS p, regexp_split_to_array(text, '{regex}') AS g FROM documents WHERE text IS NOT NULL))""")
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    shown = "kind || ':' || a || ':' || b, ',' ORDER BY a, no"
    return f"""WITH f AS (SELECT doc_id, no, kind, a, a + length(w) - skip AS b FROM ({" UNION ALL ".join(found)}) WHERE length(p) >= least),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg({shown}) FILTER (kind IN ({base})) AS base, string_agg({shown}) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN s USING (doc_id)"""


def licenses_sql() -> str:
    """Votes by diagonal, as in the operator."""
    rows = ", ".join(f"({no}, '{t.label}', {t.base}, '{t.text}')" for no, t in enumerate(license_scan.BASE + license_scan.MORE))
    k, drift, share = license_scan.K, license_scan.DRIFT, license_scan.SHARE
    return f"""WITH t(no, label, base, text) AS (VALUES {rows}), tw AS (SELECT no, label, base, string_split(text, ' ') AS w, len(w) + 1 - CASE WHEN base THEN {license_scan.K_BASE} ELSE {k} END AS grams FROM t),
tg AS (SELECT no, i AS spot, w[i + 1] AS x, w[i + 2] AS y, CASE WHEN NOT base THEN w[i + 3] END AS z FROM (SELECT no, base, w, unnest(range(0, grams)) AS i FROM tw)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
dg AS (SELECT doc_id, i, w[i + 1] AS x, w[i + 2] AS y, w[i + 3] AS z FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
v AS (SELECT doc_id, no, i - spot AS diagonal, count(*) AS n, list(DISTINCT spot) AS spots, min(spot) AS lo, max(spot) AS hi FROM dg JOIN tg ON dg.x = tg.x AND dg.y = tg.y AND (tg.z IS NULL OR dg.z = tg.z) GROUP BY ALL),
g AS (SELECT v.*, label, base, grams, base AND n = grams AS exact, sum(CASE WHEN NOT base AND gap <= {drift} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, v.no ORDER BY diagonal) AS grp
      FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, no ORDER BY diagonal) AS gap FROM v) v JOIN tw ON v.no = tw.no),
s AS (SELECT doc_id, any_value(label) AS label, any_value(base) AS base, any_value(grams) AS grams, bool_or(exact) AS exact, min(diagonal + lo) AS a, max(diagonal + hi) + {k} AS b, len(list_distinct(flatten(list(spots)))) / any_value(grams) AS share FROM g GROUP BY doc_id, no, grp),
f AS (SELECT * FROM s WHERE exact OR (NOT base AND share >= {share} AND b - a <= 2 * (grams + {k}))),
r AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(a) FILTER (exact) AS first_word, max(a) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) FILTER (NOT exact) AS best FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""


#: Exact neighbours: the operator's while it searches all lists, as it does with up to LEAST_LISTS of them.
NEIGHBOURS = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""

def codes_sql() -> str:
    """Rounds of whole-number means, one after the other. Doubles hold all numbers of vectors of unit length exactly."""
    steps = """WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, v[k * w + 1:(k + 1) * w] AS x FROM (SELECT *, unnest(range(0, 4)) AS k FROM e)),
b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS no, x FROM p SEMI JOIN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 256) USING (vec_id)),
"""
    for i in range(vector_codes.ROUNDS + 1):
        steps += f"""a{i} AS MATERIALIZED (SELECT vec_id, k, any_value(p.x) AS x, min(struct_pack(d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), no := no)) AS best FROM p JOIN b{i} b USING (k) GROUP BY vec_id, k),
"""
        if i < vector_codes.ROUNDS:
            steps += f"""m{i} AS (SELECT k, no, list(m ORDER BY i) AS x FROM (SELECT k, best.no AS no, i, floor(sum(y) / count(*)) AS m FROM (SELECT k, best, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY k, no),
b{i + 1} AS MATERIALIZED (SELECT b.k, b.no, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (k, no)),
"""
    n = vector_codes.ROUNDS
    return f"""{steps}h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k, no, i)) AS sha FROM (SELECT k, no, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM b{n})),
c AS (SELECT vec_id, string_agg(format('{{:02x}}', best.no), '' ORDER BY k) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{n} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM h) AS codebooks_sha256 FROM e JOIN c USING (vec_id)"""


def packages_sql() -> str:
    """Base32 by way of bits: a list of the digits' four bits, and one of the five bits of each letter."""
    four, five = (", ".join(f"'{i:0{n}b}'" for i in range(1 << n)) for n in (4, 5))
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, b, array_to_string(list_transform(string_split(x, ''), lambda c: [{four}][instr('0123456789abcdef', c)]), '') AS bits FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_position([{five}], bits[5 * i + 1:5 * i + 5])]), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY b) THEN 'response' ELSE 'revisit' END AS record_type, nullif(min(page_id) OVER (PARTITION BY b), page_id) AS refers_to FROM d"""


#: The CRC-32 bit by bit; each node counts for every prefix of its own.
TRIE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(length(role) || ':' || role || text ORDER BY turn NULLS FIRST, role, text) AS w, list(length(text) ORDER BY turn NULLS FIRST, role, text) AS n FROM t GROUP BY c),
crc(c, k, v) AS (SELECT c, 0, CAST(4294967295 AS BIGINT) FROM s UNION ALL
  SELECT c, k + 1, xor(u >> 1, CASE WHEN u & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
  FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(CAST(c AS VARCHAR)[k // 8 + 1]) AS BIGINT)) ELSE v END AS u FROM crc WHERE k < 8 * length(CAST(c AS VARCHAR)))),
h AS (SELECT c, CAST(xor(v, CAST(4294967295 AS BIGINT)) % 6 AS BIGINT) AS h FROM crc WHERE k = 8 * length(CAST(c AS VARCHAR))),
r AS (SELECT s.c, list_concat(coalesce(b.w, [])[1:h], s.w[h + 1:]) AS w, list_concat(coalesce(b.n, [])[1:h], s.n[h + 1:]) AS n FROM s JOIN h USING (c) LEFT JOIN s b ON b.c = s.c - s.c % 100),
p AS (SELECT c, d, w[1:d] AS w, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars, d = len(w) AS last FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)),
v AS (SELECT w, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY w, d),
k AS (SELECT w[1:d - 1] AS w, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
x AS (SELECT v.*, u.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN v u ON v.d > 0 AND u.d = v.d - 1 AND u.w = v.w[1:v.d - 1] LEFT JOIN k ON k.w = v.w),
y AS (SELECT w[1:i] AS w, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM x) GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN y USING (w)"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": TRIE,
    "op12_vector_codes": codes_sql(),
    "op13_warc_packages": packages_sql(),
    "op5_secret_scan": secrets_sql(),
    "op9_license_scan": licenses_sql(),
    "op10_nearest_neighbours": NEIGHBOURS,
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), {AZ}) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, f.first IS NOT NULL AND l.doc_id > f.first AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT item, list_slice(w, i, i + 9) AS g, 10 AS n FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
        UNION SELECT item, w, len(w) FROM b WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) d),
hit AS (SELECT o.doc_id, o.i, o.n, w.item FROM occ o JOIN win w ON o.g = w.g AND o.n = w.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_url_filter": f"""
WITH rules(rule, h, p, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {AZ}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT s.*, CASE WHEN regexp_matches(host, '\\bcheap-pills\\b') THEN 'pill-shop' WHEN regexp_matches(path, '/signin([/.]|$)') THEN 'signin-page'
        WHEN regexp_matches(host, '\\bcasino\\b') THEN 'casino-host' WHEN regexp_matches(path, '/login([/.]|$)') THEN 'login-page'
        WHEN regexp_matches(host, '\\bxxx\\b') THEN 'adult-host' WHEN regexp_matches(host, '\\bspam\\b') THEN 'spam-host' END AS word
      FROM s),
b AS (SELECT w.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS best FROM w)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NULL THEN word END AS method_rule,
       coalesce(best.verdict, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM b""",
}
