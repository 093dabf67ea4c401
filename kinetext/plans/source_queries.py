"""Queries of sources and sinks: supplied rows are written in a format and scanned back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import keypoints as K
from ..functions import text as X
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import motion
from ..operators import segments as S
from ..operators.retries import retried_paraphrases
from ..sources import files, html, nested, scratch, srt, video
from .common import VECTORS, Registry, r6, table, values

R = Registry()
add = R.add

#: Events as blocks of twenty recordings, numbered from 1.
EVENTS = "e AS (SELECT 'entry_' || user_id % 20 AS entry, event_id AS pos, event_type, epoch_us(ts) // 1000 % 86400000 AS start_ms, epoch_us(ts) // 1000 % 86400000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS INTEGER) AS block_idx FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") % 86_400_000
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("entry_"), F.col("user_id") % 20).alias("entry"), F.col("event_id").alias("pos"), "event_type", start.alias("start_ms"), (start + F.floor(F.col("value") * 1000).cast("long")).alias("end_ms")
    )


def written(spark: SparkSession, blocks: DataFrame, **options) -> DataFrame:
    """The blocks as one subtitle file an entry, read as whole texts."""
    path = scratch.folder(spark)
    srt.write(blocks, path, **options)
    return srt.files(spark, f"{path}/*/*.txt")


TIMES = "entry", "block_idx", "start_ms", "end_ms", "text"


@add(f"WITH {EVENTS} SELECT entry, block_idx, start_ms, end_ms, 'A: ' || event_type AS text FROM e WHERE pos % 4 <> 0")
def srt_strict(spark, sf_dir):
    """Blocks of four lines are written too, and left out by the scan."""
    text = F.concat(F.lit("A: "), "event_type", F.when(F.col("pos") % 4 == 0, "\nmore").otherwise(""))
    return srt.scan_strict(written(spark, events(spark, sf_dir).withColumn("text", text))).select(*TIMES)


@add(f"WITH {EVENTS} SELECT entry, block_idx, start_ms, end_ms, event_type || CASE WHEN pos % 4 = 0 THEN chr(10) || 'more of ' || pos ELSE '' END AS text FROM e")
def srt_lenient(spark, sf_dir):
    text = F.concat("event_type", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("\nmore of "), "pos")).otherwise(""))
    return srt.scan_lenient(written(spark, events(spark, sf_dir).withColumn("text", text))).select(*TIMES)


@add(f"WITH {EVENTS} SELECT entry, block_idx, start_ms, end_ms, event_type || ' line two' AS text, event_type = 'signup' AS is_full FROM e")
def srt_checked(spark, sf_dir):
    """After a byte order mark; lines are joined, the marker is read."""
    full = F.when(F.col("event_type") == "signup", X.FULL).otherwise("")
    whole = srt.render(events(spark, sf_dir).withColumn("text", F.concat("event_type", F.lit("\n line two"), full)))
    path = scratch.folder(spark)
    whole.withColumn("value", F.concat(F.lit("\ufeff"), "value")).write.partitionBy("entry").text(path)
    return srt.scan_checked(srt.files(spark, f"{path}/*/*.txt")).select(*TIMES, "is_full")


@add(f"WITH {EVENTS} SELECT entry, CAST(pos % 7 AS INTEGER) AS block_idx, arg_max(event_type || pos, pos) AS text, arg_max(start_ms, pos) AS start_ms FROM e GROUP BY entry, pos % 7")
def srt_last_by_index(spark, sf_dir):
    block = F.concat_ws("\n", (F.col("pos") % 7).cast("string"), F.concat(X.ms_to_clock("start_ms"), F.lit(" --> "), X.ms_to_clock("end_ms")), F.concat("event_type", "pos"))
    rows = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))  # one recording
    whole = events(spark, sf_dir).groupBy("entry").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n").alias("value"))
    path = scratch.folder(spark)
    whole.write.partitionBy("entry").text(path)
    return srt.last_by_index(srt.scan_strict(srt.files(spark, f"{path}/*/*.txt"))).select("entry", "block_idx", "text", "start_ms")


@add(f"WITH {EVENTS} SELECT entry, block_idx, 'A: ' || event_type AS text, event_type IN ('signup', 'click') AS is_full, event_type IN ('purchase', 'click') AS is_end FROM e")
def srt_markers(spark, sf_dir):
    t = F.col("event_type")
    marked = events(spark, sf_dir).withColumns({"is_full": t.isin("signup", "click"), "is_end": t.isin("purchase", "click"), "text": t, "speaker": F.lit("A")})
    return srt.with_markers(srt.scan_lenient(written(spark, marked, text=srt.marked_text(marked)))).select("entry", "block_idx", "text", "is_full", "is_end")


@add("SELECT 'entry_' || 2 * r_regionkey AS entry FROM region")
def entries_with_all(spark, sf_dir):
    """Every entry has a transcript, every other one keypoints too."""
    path, n = scratch.folder(spark), 2 * table(spark, sf_dir, "region").count()
    for i in range(n):
        scratch.put(spark, f"{path}/entry_{i}/transcript.srt", "1\n")
        if i % 2 == 0:
            scratch.put(spark, f"{path}/entry_{i}/openpose.json", "[]")
    return srt.with_all(spark, path, ["transcript.srt", "openpose.json"])


@add("SELECT conv_id, turn, role, text FROM conversations")
def csv_quoted(spark, sf_dir):
    """Texts with quotes, commas and line breaks."""
    path = scratch.folder(spark)
    files.write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path, quote_all=True)
    return files.csv(spark, path, "conv_id long, turn long, role string, text string")


@add("SELECT event_id, props, value FROM events")
def csv_pipes(spark, sf_dir):
    path = scratch.folder(spark)
    files.write_csv(table(spark, sf_dir, "events").select("event_id", "props", "value"), path, sep="|")
    return files.csv(spark, path, "event_id long, props string, value double", sep="|")


@add("SELECT DISTINCT upper(source) || '-' || lang AS gloss FROM documents")
def csv_first_column(spark, sf_dir):
    path = scratch.folder(spark)
    name = F.concat(F.lit(" "), F.upper("source"), F.lit("-"), "lang")
    files.write_csv(table(spark, sf_dir, "documents").select(name.alias("Gloss/Type"), "doc_id"), path, quote_all=True)
    return files.first_column(spark, path)


@add("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def csv_union(spark, sf_dir):
    """Two folders with headers of their own, and one that is not there."""
    paths = [scratch.folder(spark) for _ in range(3)]
    files.write_csv(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), paths[0])
    files.write_csv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), paths[2])
    return files.with_suffix_unioned(spark, paths, "id int, name string")


@add("SELECT item_id, text FROM benchmark")
def json_lines(spark, sf_dir):
    path = scratch.folder(spark)
    files.write_json(table(spark, sf_dir, "benchmark"), path)
    return spark.read.schema("item_id long, text string").json(path)


@add("SELECT n_name AS term FROM nation")
def text_lines(spark, sf_dir):
    """Lines with blanks at their ends, and blank ones between."""
    path = scratch.folder(spark)
    files.write_lines(table(spark, sf_dir, "nation"), path, F.concat(F.lit(" "), "n_name", F.lit(" \n  \n")))
    return files.lines(spark, path)


@add("""WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split(' ' || p_brand || ', ,' || coalesce(p_type, '') || ',' || lower(p_name) || ' ,', ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, CAST(generate_subscripts(l, 1) AS INTEGER) AS pos, upper(unnest(l)) AS gloss FROM l""")
def literal_list(spark, sf_dir):
    written = F.concat(F.lit(" "), "p_brand", F.lit(", ,"), F.coalesce("p_type", F.lit("")), F.lit(","), F.lower("p_name"), F.lit(" ,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(files.literal_items(written)))


@add("SELECT CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation")
def file_sizes(spark, sf_dir):
    path = scratch.folder(spark)
    files.write_lines(table(spark, sf_dir, "nation"), path, F.col("n_name"))
    return files.file_sizes(spark, f"{path}/*.txt").agg(F.sum("size").alias("bytes"))


@add("SELECT lang, lang || ':' || chr(10) || string_agg('- ' || source, chr(10) ORDER BY source) AS value FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def grouped_report(spark, sf_dir):
    return files.grouped_report(table(spark, sf_dir, "documents"), "lang", "source")


@add("SELECT s_suppkey, 'name: ' || s_name || chr(10) || 'nation: ' || s_nationkey AS config FROM supplier")
def rendered_config(spark, sf_dir):
    return files.render_config(table(spark, sf_dir, "supplier"), "name: %s\nnation: %s", ["s_name", "s_nationkey"]).select("s_suppkey", "config")


@add(f"WITH {EVENTS} SELECT entry || '/video.mp4' AS path, start_ms / 1000 AS start, CAST(end_ms - start_ms AS DOUBLE) / 1000 AS duration, event_type || '.mp4' AS out_name FROM e WHERE end_ms > start_ms")
def clip_plan(spark, sf_dir):
    return files.clip_plan(events(spark, sf_dir), F.concat("entry", F.lit("/video.mp4")), F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.concat("event_type", F.lit(".mp4")))


LABELS = ("click", "error")
CELLS = ", ".join(f"printf('%.4f', {f}({m}) FILTER (event_type = '{x}')) AS {x}_{name}_{m}" for x in LABELS for m in ("sal", "msj") for name, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp")))


@add(f"SELECT {CELLS} FROM (SELECT event_type, -value AS sal, value * value / 1000 AS msj FROM events)")
def comparison_table(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select("event_type", (-F.col("value")).alias("sal"), (F.col("value") * F.col("value") / 1000).alias("msj"))
    return motion.smoothness_table(scores, "event_type", LABELS)


#: Points of 25, of which a stored frame keeps the upper body.
BODY25, KEPT = "list_concat(v, v[1:11])", ", ".join(str(p) for p in K.UPPER_BODY)


@add(f"WITH {VECTORS}, p AS (SELECT 'entry_' || label AS entry, CAST(vec_id AS INTEGER) AS frame, unnest([{KEPT}]) AS p, generate_subscripts([{KEPT}], 1) - 1 AS n, {BODY25} AS b FROM v) SELECT entry, 'B' AS speaker, frame, CAST(3 * n + k AS BIGINT) AS i, round(CASE k WHEN 0 THEN b[3 * p + 1] / 640 WHEN 1 THEN b[3 * p + 2] / 360 ELSE b[3 * p + 3] END, 6) + 0.0 AS value FROM p, range(3) r(k)")
def camera_frames(spark, sf_dir):
    """Keypoint documents with keys beyond the schema: the first camera is left out by its name, the second is speaker B."""
    v = F.col("embedding").cast("array<double>")
    person = F.struct(F.concat(v, F.slice(v, 1, 11)).alias("pose_keypoints_2d"), *(F.slice(v, 1, 12).alias(k) for k in schemas.KEYPOINT_KEYS[1:]), F.slice(v, 1, 4).alias("pose_keypoints_3d"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("entry_"), "label").alias("entry"), F.col("vec_id").cast("string").alias("f"), F.struct(F.array(person).alias("people")).alias("b"))
    frames = F.map_from_entries(F.collect_list(F.struct("f", "b")))  # a recording
    camera = lambda name: F.struct(F.lit(name).alias("camera"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.col("frames"))
    path = scratch.folder(spark)
    rows.groupBy("entry").agg(frames.alias("frames")).select("entry", F.to_json(F.array(camera("c"), camera("b1"))).alias("value")).write.partitionBy("entry").text(path)
    found = D.people(nested.camera_frames(spark, f"{path}/*/*.txt"))
    return values(found, F.col("person.pose_keypoints_2d"), "entry", "speaker", "frame")


def _people(spark, sf_dir):
    """A person of each vector, for its label."""
    v = F.col("embedding").cast("array<double>")
    person = F.struct(*(F.slice(v, 16 * i + 1, 15).alias(k) for i, k in enumerate(schemas.KEYPOINT_KEYS)))
    return table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("G"), "label").alias("gloss")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", person.alias("p")))), lambda x: x["p"]).alias("pose_sequence"))


PEOPLE = f"WITH {VECTORS} SELECT 'G' || label AS gloss, count(*) AS frames, round(sum(v[1]) + sum(v[49 + 14]), 6) + 0.0 AS ends FROM v GROUP BY label"


def _ends(found: DataFrame) -> DataFrame:
    ends = F.aggregate("pose_sequence", F.lit(0.0), lambda a, p: a + p["pose_keypoints_2d"][0] + p["hand_right_keypoints_2d"][14])
    return found.select("gloss", F.size("pose_sequence").cast("long").alias("frames"), r6(ends).alias("ends"))


@add(PEOPLE)
def pose_documents(spark, sf_dir):
    """{"data": [...]} documents, with one that is broken."""
    path = scratch.folder(spark)
    docs = _people(spark, sf_dir).select(F.col("gloss").alias("g"), F.to_json(F.struct(F.array(F.struct("gloss", "pose_sequence")).alias("data"))).alias("value"))
    docs.write.partitionBy("g").text(path)
    scratch.put(spark, f"{path}/g=broken/part.txt", '{"data": [')
    return _ends(files.pose_items(spark, f"{path}/*/*.txt"))


@add(PEOPLE)
def pose_dictionaries(spark, sf_dir):
    """Documents that map glosses to sequences."""
    path = scratch.folder(spark)
    _people(spark, sf_dir).select(F.col("gloss").alias("g"), F.to_json(F.create_map("gloss", "pose_sequence")).alias("value")).write.partitionBy("g").text(path)
    return _ends(nested.pose_dictionary(spark, f"{path}/*/*.txt"))


@add("""WITH r AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 50.0 ELSE CAST(s_nationkey + 20 AS DOUBLE) END AS fps FROM supplier)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(trunc(l_orderkey % 100000 / 1000.0 * fps) AS INTEGER) AS frame FROM lineitem JOIN r ON l_suppkey = s_suppkey""")
def frames_of_recordings(spark, sf_dir):
    """A supplier's recording has a rate of its own, in its header; every fifth nation's has none and the usual one holds."""
    s = table(spark, sf_dir, "supplier")
    scale = F.lit(1000) + F.col("s_suppkey") % 100
    told = s.where("s_nationkey % 5 <> 0").select(F.concat(F.lit("entry_"), "s_suppkey").alias("entry"), scale.cast("long").alias("scale"), (10 * scale).cast("long").alias("length"), ((F.col("s_nationkey") + 20) * 10).cast("long").alias("frames"))
    path = scratch.folder(spark)
    video.write_headers(told, path).count()
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("entry_"), "l_suppkey").alias("entry"), "l_orderkey", "l_linenumber")
    timed = video.with_rates(items, video.frame_rates(spark, f"{path}/*/video.mp4"))
    return timed.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), X.ms_to_frame(F.col("l_orderkey") % 100_000, F.col("fps")).alias("frame"))


@add("SELECT CAST(vec_id AS INTEGER) AS idx, 'G' || label AS gloss, CAST(len(embedding) AS INTEGER) AS size, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings")
def vector_matrix(spark, sf_dir):
    path = scratch.folder(spark)
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("idx"), F.concat(F.lit("G"), "label").alias("gloss"), "embedding").write.parquet(path)
    return files.vectors(spark, path).select("idx", "gloss", F.size("embedding").alias("size"), r6(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


#: Frames of three sizes; the stored sizes are those of multiples of three, but for two arrays.
@add("""WITH s AS (SELECT 'G' || label AS gloss, vec_id % 3 AS k FROM embeddings), p AS (SELECT gloss, unnest(['pose_keypoints_2d', 'face_keypoints_2d', 'hand_left_keypoints_2d', 'hand_right_keypoints_2d']) AS part, unnest([39, 210, 63, 63]) AS expected, unnest([39 + k, 210, 63 - k, 0]) AS actual FROM s)
SELECT DISTINCT gloss, part, CAST(expected AS INTEGER) AS expected, CAST(actual AS INTEGER) AS actual FROM p WHERE expected <> actual""")
def dictionary_audit(spark, sf_dir):
    k = (F.col("vec_id") % 3).cast("int")
    parts = [F.array_repeat(F.lit(0.5), n) for n in (39 + k, F.lit(210), 63 - k, F.lit(0))]
    person = F.struct(*(p.alias(name) for p, name in zip(parts, schemas.KEYPOINT_KEYS, strict=True)))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("G"), "label").alias("gloss"), F.array(person).alias("pose_sequence"))
    return D.dictionary_audit(rows)


LINES = """t AS (SELECT event_id AS pos, upper(event_type) AS g FROM events), k AS (
 SELECT pos, 0 AS subpos, 'A' AS speaker, g AS text, false AS is_full FROM t WHERE pos % 5 = 0 AND g IN ('CLICK', 'SIGNUP') UNION ALL
 SELECT pos, 0, 'B', 'Das ist ' || lower(g) || '.', true FROM t WHERE pos % 5 = 1 UNION ALL
 SELECT pos, unnest([0, 1]), 'A', unnest([g, 'ICH1']), false FROM t WHERE pos % 5 = 3)"""


@add(f"WITH {LINES} SELECT pos, CAST(subpos AS INTEGER) AS subpos, speaker, text, is_full, 0::BIGINT AS start_ms, CASE WHEN is_full THEN 5000 ELSE 2000 END::BIGINT AS end_ms FROM k")
def kept_lines(spark, sf_dir):
    """Glosses of known types, sentences and double glosses are kept and labelled; a third speaker and other lines go."""
    g, no = F.upper("event_type"), F.col("event_id") % 5
    text = F.when(no == 0, F.concat(F.lit("A: *"), g, F.lit("^"))).when(no == 1, F.concat(F.lit("B: Das ist "), F.lower(g), F.lit("."))).when(no == 2, F.concat(F.lit("C: Das sagt "), F.lower(g))).when(no == 3, F.concat(F.lit("A: "), g, F.lit("||ICH1"))).otherwise(F.concat(F.lit("B: kein "), F.lower(g)))
    blocks = table(spark, sf_dir, "events").select(F.lit("entry_1").alias("entry"), F.col("event_id").alias("pos"), F.lit(0).cast("long").alias("start_ms"), F.lit(5000).cast("long").alias("end_ms"), text.alias("text"))
    types = spark.createDataFrame([("CLICK^",), ("SIGNUP",)], "gloss string")
    return S.split_speakers(S.filter_lines(blocks, types)).select("pos", "subpos", "speaker", "text", "is_full", "start_ms", "end_ms")


@add("WITH q AS (SELECT user_id AS query, event_id AS pos, CASE WHEN event_type = 'error' THEN 'NONE' ELSE upper(event_type) END AS gloss FROM events) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos) AS INTEGER) AS pos, gloss, CAST(length(gloss) AS INTEGER) AS frames FROM q WHERE gloss <> 'NONE'")
def dictionary_lookup(spark, sf_dir):
    """Words in their order with repeats; those the dictionary lacks are left out and the rest renumbered."""
    e = table(spark, sf_dir, "events")
    words = e.select(F.col("user_id").alias("query"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "NONE").otherwise(F.upper("event_type")).alias("gloss"))
    known = e.select(F.upper("event_type").alias("gloss")).distinct().where("gloss <> 'ERROR'").withColumn("pose_sequence", F.array_repeat(F.lit(1.0), F.length("gloss")))
    return motion.lookup(words, known).select("query", "pos", "gloss", F.size("pose_sequence").alias("frames"))


@add(f"WITH {VECTORS}, f AS (SELECT vec_id, list_concat(v, v[1:32]) AS f, v[1] AS nx, v[2] AS ny, CASE WHEN vec_id % 4 <> 0 THEN 1.5 END AS sx FROM v), c AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN f[1:90] ELSE f END AS g, nx, ny, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE sx END AS sx, f FROM f) SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(CASE WHEN sx IS NULL OR (i - 1) % 3 = 2 THEN x WHEN (i - 1) % 3 = 0 THEN nx + (x - f[91]) * sx ELSE ny + (x - f[92]) * 0.5 END, 6) + 0.0 AS value FROM (SELECT *, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM c)")
def place_face(spark, sf_dir):
    """A face of 96 values about its nose tip; of 90 values, or without a scale, it stays."""
    v = F.col("embedding").cast("array<double>")
    face = F.concat("v", F.slice("v", 1, 32))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("face", F.when(F.col("vec_id") % 3 == 0, F.slice(face, 1, 90)).otherwise(face))
    sx = F.when(F.col("vec_id") % 4 != 0, F.lit(1.5))
    return values(rows, K.place_face("face", F.get("v", F.lit(0)), F.get("v", F.lit(1)), sx, F.lit(0.5)), "vec_id")


@add("SELECT DISTINCT gloss FROM (SELECT rtrim(p_brand || CASE WHEN p_partkey % 3 = 0 THEN '^^' ELSE '' END, '^') AS gloss FROM part) WHERE gloss NOT IN ('Brand#1', 'Brand#20') AND NOT contains(gloss, '#1')")
def prune_types(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "^^").otherwise("")).alias("gloss"))
    return S.prune_types(types, ("Brand#1", "Brand#20"), ("#1",))


@add("""WITH b AS (SELECT user_id AS entry, event_id AS pos, event_id % 7 <> 0 AS own, event_type = 'signup' AS is_full, event_type = 'purchase' AS is_end, event_type || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END AS text, event_id * 10 AS s, event_id * 10 + 35 AS e FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN NOT own OR is_end THEN 1 ELSE 0 END) OVER (PARTITION BY entry ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM b),
f AS (SELECT entry, run, bool_or(own AND is_end) AS ended, min(pos) FILTER (own AND is_full AND NOT is_end) AS first FROM r GROUP BY entry, run)
SELECT r.entry, first AS pos, rtrim(arg_min(text, r.pos), '/') AS full_sentence, string_agg(text || CASE WHEN is_full THEN '_FULL_SENTENCE' ELSE '' END, ',' ORDER BY r.pos) FILTER (r.pos > first) AS glosses, CAST(trunc(min(s) / 1000 * 50) AS INTEGER) AS start_frame, CAST(trunc(arg_min(e, r.pos) / 1000 * 50) AS INTEGER) AS end_frame
FROM r JOIN f ON r.entry = f.entry AND r.run = f.run WHERE ended AND first IS NOT NULL AND r.pos >= first GROUP BY r.entry, r.run, first""")
def forward_sentences(spark, sf_dir):
    pos = F.col("event_id")
    blocks = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), pos.alias("pos"), (F.col("event_type") == "signup").alias("is_full"), (F.col("event_type") == "purchase").alias("is_end"), F.concat("event_type", F.when(pos % 2 == 0, "/").otherwise("")).alias("text"), (pos * 10).alias("start_ms"), (pos * 10 + 35).alias("end_ms"))
    return S.forward_sentences(blocks, F.col("pos") % 7 != 0)


@add("""WITH RECURSIVE c AS (SELECT DISTINCT p_name AS t, [upper(p_name), '', p_name, upper(p_name), p_name || '!', 'a a a a a a', CASE WHEN p_name LIKE 'b%' THEN p_name ELSE p_name || '?' END, lower(p_name) || '.'] AS c FROM part),
s AS (SELECT t, c, 0 AS i, []::VARCHAR[] AS taken, 0 AS missed FROM c UNION ALL
 SELECT t, c, i + 1, CASE WHEN missed < 3 AND len(taken) < 3 AND ok THEN list_append(taken, x) ELSE taken END, CASE WHEN missed < 3 AND len(taken) < 3 THEN CASE WHEN ok THEN 0 ELSE missed + 1 END ELSE missed END
 FROM (SELECT *, c[i + 1] AS x, c[i + 1] NOT IN ('', t, 'a a a a a a') AND NOT list_contains(taken, c[i + 1]) AS ok FROM s WHERE i < len(c)))
SELECT t AS name, unnest(taken) AS paraphrase FROM s WHERE i = len(c)""")
def paraphrases(spark, sf_dir):
    """Candidates stand for what a model draws; one in eight is degenerate."""
    def drawn(t):
        return F.array(F.upper(t), F.lit(""), t, F.upper(t), F.concat(t, F.lit("!")), F.lit("a a a a a a"), F.when(t.like("b%"), t).otherwise(F.concat(t, F.lit("?"))), F.concat(F.lower(t), F.lit(".")))

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return C.paraphrases(names, drawn, "name", n=3, tries=3).select("name", "paraphrase")


@add("""WITH RECURSIVE s AS (SELECT p_partkey, p_name AS t, []::VARCHAR[] AS taken, 0 AS missed, 0 AS calls FROM part UNION ALL
 SELECT p_partkey, t, CASE WHEN ok THEN list_append(taken, x) ELSE taken END, CASE WHEN ok THEN 0 ELSE missed + 1 END, calls + 1
 FROM (SELECT *, x NOT IN ('', t, 'no no no no no') AND NOT list_contains(taken, x) AS ok
       FROM (SELECT *, CASE WHEN (p_partkey + 3 * len(taken) + missed) % 4 = 0 THEN t WHEN (p_partkey + missed) % 5 = 1 THEN 'no no no no no' WHEN missed = 1 THEN list_extract(list_concat([t], taken), -1) ELSE upper(t) || ' ' || (p_partkey % 3 + len(taken) // 2) END AS x FROM s WHERE len(taken) < 3 AND missed < 4)))
SELECT p_partkey, array_to_string(taken, '|') AS paraphrases, calls FROM s WHERE len(taken) >= 3 OR missed >= 4""")
def paraphrase_retries(spark, sf_dir):
    """What the generator, which stands for a model, says depends on what it must not say again and on the attempt."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    numbers = F.col("p_partkey")

    def generate(text, exclude, attempt):
        key = F.element_at(F.split(text, " #"), 2).cast("long")
        own = F.element_at(F.split(text, " #"), 1)
        n = F.size(exclude) - 1
        said = F.element_at(exclude, -1)
        return F.when((key + 3 * n + attempt) % 4 == 0, text).when((key + attempt) % 5 == 1, F.lit("no no no no no")).when(attempt == 1, said).otherwise(F.concat(F.upper(own), F.lit(" "), (key % 3 + F.floor(n / 2)).cast("string")))

    found = retried_paraphrases(parts.withColumn("line", F.concat("p_name", F.lit(" #"), numbers.cast("string"))), generate, "line", n=3, tries=4)
    return found.select("p_partkey", F.array_join("paraphrases", "|").alias("paraphrases"), "calls")


@add("SELECT n_regionkey AS page_id, CAST(n AS INTEGER) AS row_no, n_name AS name, 'http://h.org/srt/' || n_nationkey || '.srt' AS link FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation) WHERE n < 3 AND n_nationkey % 2 = 0")
def table_scrape(spark, sf_dir):
    """The first three rows of a page's table, less those without the link."""
    cell = F.concat(F.lit("<tr><td><b>"), "n_name", F.lit("</b></td><td>"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<a href='/srt/"), "n_nationkey", F.lit(".srt'>get</a>"))).otherwise("-"), F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("c")))), lambda x: x["c"]), "").alias("rows"))
    pages = rows.select(F.col("n_regionkey").alias("page_id"), F.lit("http://h.org/list.html").alias("url"), F.concat(F.lit("<table><tr><th>Name</th><th>SRT</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    found = html.table_rows(pages, "SRT", max_entries=3)
    return found.select("page_id", "row_no", F.col("cells")["Name"]["text"].alias("name"), F.col("cells")["SRT"]["link"].alias("link"))


@add(f"WITH {EVENTS} SELECT entry, pos, event_type FROM e WHERE CAST(substr(entry, 7) AS INTEGER) >= 7")
def from_entry(spark, sf_dir):
    return files.from_entry(events(spark, sf_dir), "entry_7").select("entry", "pos", "event_type")


CLOCKS = "printf('%02d:%02d:%06.3f', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s % 3600) / 60) AS INTEGER), s % 60)"


@add(f"""WITH t AS (SELECT event_id, event_id * 7 % 86400 + event_id % 1000 / 1000 AS s, event_type FROM events)
SELECT event_id, {CLOCKS} AS clock, printf('%02d:%02d:%02d.%03d', event_id % 24, event_id % 60, 5, event_id % 1000) AS parts, round(s, 3) AS seconds, event_type || ',x,' || event_id AS list, event_type AS answer, event_type || chr(228) AS composed FROM t""")
def time_and_text_scalars(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    s = i * 7 % 86400 + i % 1000 / 1000
    return e.select(
        "event_id", X.seconds_to_clock(s).alias("clock"), X.clock_of_parts(i % 24, i % 60, F.lit(5), i % 1000).alias("parts"), F.round(X.srt_to_seconds(X.ms_to_clock(F.round(s * 1000).cast("long"))), 3).alias("seconds"),
        X.comma_list(F.concat(F.lit(" "), "event_type", F.lit("  x\t"), "event_id")).alias("list"), X.after_last(F.concat(F.lit("why<think>so<think> "), "event_type")).alias("answer"), X.nfc(F.concat("event_type", F.lit("a\u0308"))).alias("composed"),
    )


@add("""WITH t AS (SELECT event_id, 300 + event_id % 900 AS h, 400 + event_id * 13 % 900 AS w FROM events), c AS (SELECT *, CASE WHEN h > w THEN 1024 ELSE 576 END AS ch, CASE WHEN h > w THEN 576 ELSE 1024 END AS cw FROM t)
SELECT event_id, CAST(CASE WHEN h / w < ch / cw THEN ch ELSE ceil(cw * (h / w)) END AS INTEGER) AS resize_h, CAST(CASE WHEN h / w < ch / cw THEN ceil(ch / (h / w)) ELSE cw END AS INTEGER) AS resize_w, CAST(ch AS INTEGER) AS crop_h, CAST(cw AS INTEGER) AS crop_w FROM c""")
def image_geometry(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", X.target_size(300 + i % 900, 400 + i * 13 % 900, 576).alias("x")).select("event_id", "x.*")


@add("SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'error')")
def flagged_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("A: "), "event_type").alias("text"), F.when(F.col("event_id") % 3 == 0, " TRUE ").otherwise("no").alias("ok"))
    kept = S.flagged(e, "ok")
    return S.with_text(kept, "click").unionByName(S.with_text(kept, "error")).select("event_id")
