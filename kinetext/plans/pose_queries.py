"""Queries on keypoints and motion, over vectors read as pose frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keypoints as K
from ..operators import dictionary as D
from ..operators import matching, motion
from .common import PARTS, VECTORS, Registry, r6, table, values, vector_frames

R = Registry()
add = R.add

EACH = "SELECT {keys}, CAST(i - 1 AS BIGINT) AS i, round({value}, 6) + 0.0 AS value FROM (SELECT *, unnest({arr}) AS x, generate_subscripts({arr}, 1) AS i FROM {source})"


def rows(arr: str, keys: str = "vec_id", value: str = "x", source: str = "v") -> str:
    return EACH.format(arr=arr, keys=keys, value=value, source=source)


@add(f"WITH {VECTORS} " + rows("v[1:63]", value="CASE (i - 1) % 3 WHEN 0 THEN x / 640 WHEN 1 THEN x / 360 ELSE x END"))
def normalize_keypoints(spark, sf_dir):
    return values(vector_frames(spark, sf_dir), K.normalize(F.slice("v", 1, 63), F.lit(640), F.lit(360)), "vec_id")


#: Points that stand for the upper body in 21 points.
POINTS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 17, 18)


@add(f"WITH {VECTORS} " + rows("list_concat(v[1:27], v[46:57])"))
def select_keypoints(spark, sf_dir):
    return values(vector_frames(spark, sf_dir), K.select_points("v", POINTS), "vec_id")


@add(f"WITH {VECTORS}, z AS (SELECT vec_id, list_concat(v[1:27], list_transform(range(18), lambda x: 0.0), v[46:57], list_transform(range(18), lambda x: 0.0)) AS a FROM v) " + rows("a", source="z"))
def restore_keypoints(spark, sf_dir):
    return values(vector_frames(spark, sf_dir), K.restore_points(K.select_points("v", POINTS)), "vec_id")


X3, Y3 = "list_filter(v[1:63], lambda x, i: (i - 1) % 3 = 0)", "list_filter(v[1:63], lambda x, i: (i - 1) % 3 = 1)"


@add(f"WITH {VECTORS} SELECT vec_id, round(list_max({X3}) - list_min({X3}), 6) AS w, round(list_max({Y3}) - list_min({Y3}), 6) AS h FROM v")
def bounding_boxes(spark, sf_dir):
    w, h = K.box(F.slice("v", 1, 63))
    return vector_frames(spark, sf_dir).select("vec_id", r6(w).alias("w"), r6(h).alias("h"))


C3 = "list_sum(list_filter(v[1:63], lambda x, i: (i - 1) % 3 = 2))"


@add(f"WITH {VECTORS} SELECT CAST(label AS INTEGER) AS label, round(avg({C3}), 6) + 0.0 AS avg_conf FROM v GROUP BY label")
def conf_avg(spark, sf_dir):
    return vector_frames(spark, sf_dir).groupBy("label").agg(r6(F.avg(K.confidence(F.col("frame")))).alias("avg_conf"))


@add("SELECT o_custkey AS gloss, o_orderdate AS entry, o_orderkey AS item_no, o_totalprice AS avg_conf, o_orderpriority AS pose_sequence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS n FROM (SELECT * REPLACE (floor(o_totalprice / 50000) AS o_totalprice) FROM orders)) WHERE n = 1")
def best_per_key(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gloss"), F.col("o_orderdate").alias("entry"), F.col("o_orderkey").alias("item_no"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("avg_conf"), F.col("o_orderpriority").alias("pose_sequence"))
    return D.best_per_key(items, "gloss", "avg_conf", ["entry", "item_no"], ["pose_sequence"])


@add(f"""WITH {VECTORS}, s AS (SELECT label, vec_id // 4 AS entry, avg({C3}) AS avg_conf, count(*) AS frames FROM v GROUP BY ALL HAVING NOT bool_or(vec_id % 7 = 0)),
w AS (SELECT DISTINCT label FROM v WHERE label % 2 = 0 AND vec_id % 3 = 0), r AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY round(avg_conf, 9) DESC, entry) AS n FROM s SEMI JOIN w ON s.label = w.label)
SELECT 'L' || label AS gloss, entry, round(avg_conf, 6) + 0.0 AS avg_conf, frames FROM r WHERE n = 1""")
def dictionary_built(spark, sf_dir):
    """Runs of frames with a label; every seventh vector lacks a value and spoils its run. Of the wanted labels' sound runs the surest stays."""
    short = lambda f: F.struct(*(F.when(F.col("vec_id") % 7 == 0, F.slice(f[k], 1, 11)).otherwise(f[k]).alias(k) if k == "hand_right_keypoints_2d" else f[k].alias(k) for k in PARTS))
    frames = vector_frames(spark, sf_dir).select(F.concat(F.lit("L"), "label").alias("gloss"), "label", "vec_id", F.floor(F.col("vec_id") / 4).alias("entry"), short(F.col("frame")).alias("frame"))
    runs = frames.groupBy("gloss", "entry").agg(F.array_sort(F.collect_list(F.struct("vec_id", "frame"))).alias("x"))  # four frames at most
    runs = runs.select("gloss", "entry", F.transform("x", lambda x: x["frame"]).alias("pose_sequence"))
    wanted = frames.where("label % 2 = 0 AND vec_id % 3 = 0").select("gloss")
    found = D.build_dictionary(runs, wanted, ["entry"], (27, 12, 12, 12))
    return found.select("gloss", "entry", r6("avg_conf").alias("avg_conf"), F.size("pose_sequence").cast("long").alias("frames"))


@add(f"WITH {VECTORS}, a AS (SELECT vec_id, unnest(['pose_keypoints_2d', 'face_keypoints_2d', 'hand_left_keypoints_2d', 'hand_right_keypoints_2d']) AS part, unnest([27, 12, 12, 11]) AS expected, unnest([27, 12, 12, 12]) AS actual FROM v) SELECT vec_id, part, CAST(expected AS INTEGER) AS expected, CAST(actual AS INTEGER) AS actual FROM a WHERE expected <> actual")
def corruption_audit(spark, sf_dir):
    return D.size_audit(vector_frames(spark, sf_dir), "frame", (27, 12, 12, 11), ["vec_id"])


@add("SELECT entry, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS entry, l_returnflag, l_linestatus FROM lineitem) GROUP BY entry HAVING count(*) > 1")
def dims_having(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry"), F.struct(F.col("l_returnflag").alias("width"), F.col("l_linestatus").alias("height")).alias("cam"))
    return D.files_with_several_sizes(li).select("entry", F.size("sizes").cast("long").alias("n"))


@add("SELECT l_returnflag AS width, l_linestatus AS height, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY ALL")
def camera_sizes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry"), F.struct(F.col("l_returnflag").alias("width"), F.col("l_linestatus").alias("height")).alias("cam"))
    return D.camera_sizes(li)


DIST = "sqrt(pow({a}[{j}] - {b}[{i}], 2) + pow({a}[{j} + 1] - {b}[{i} + 1], 2))"


def dist(v: str, a: int, b: int) -> str:
    return f"sqrt(pow({v}[{3 * b + 1}] - {v}[{3 * a + 1}], 2) + pow({v}[{3 * b + 2}] - {v}[{3 * a + 2}], 2))"


SCALED = f"""{VECTORS}, r AS (SELECT *, first_value(v) OVER (ORDER BY vec_id) AS f FROM v), s AS (SELECT vec_id, v, ({dist('f', 2, 5)} / {dist('v', 2, 5)} + {dist('f', 0, 8)} / {dist('v', 0, 8)}) / 2 AS k, {dist('f', 1, 0)} AS neck, row_number() OVER (ORDER BY vec_id) AS rn FROM r),
p AS (SELECT vec_id, k, neck, rn, list_transform(v[1:27], lambda x, i: CASE WHEN rn > 1 AND i % 3 <> 0 THEN x * k ELSE x END) AS b FROM s),
q AS (SELECT vec_id, CASE WHEN rn = 1 THEN b ELSE list_concat([b[4] + (b[1] - b[4]) * (neck / {dist('b', 1, 0)}), b[5] + (b[2] - b[5]) * (neck / {dist('b', 1, 0)})], b[3:]) END AS b FROM p)"""


@add(f"WITH {SCALED} " + rows("b", source="q"))
def scale_to_reference(spark, sf_dir):
    seqs = vector_frames(spark, sf_dir).select(F.lit(1).alias("query"), F.col("vec_id").alias("pos"), F.array("frame").alias("pose_sequence"))
    out = motion.scale_to_first(seqs).select(F.col("pos").alias("vec_id"), F.get("pose_sequence", F.lit(0)).alias("f"))
    return values(out, F.col("f.pose_keypoints_2d"), "vec_id")


def pairs(spark, sf_dir):
    """Each frame with the next of its sequence."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return vector_frames(spark, sf_dir).withColumn("next", F.lead("frame").over(w)).where(F.col("next").isNotNull())


NEXT = f"{VECTORS}, n AS (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM v), nn AS (SELECT * FROM n WHERE nx IS NOT NULL)"


def blend_sql(a: str, b: str, alpha: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z, i: CASE WHEN i % 3 = 0 THEN z[2] ELSE (1 - {alpha}) * z[1] + {alpha} * z[2] END)"


@add(f"WITH {NEXT}, g AS (SELECT vec_id, k, {blend_sql('v[1:27]', 'nx[1:27]', '(k / 8)')} AS a FROM (SELECT *, unnest(range(1, 8)) AS k FROM nn)) " + rows("a", "vec_id, k AS step", source="g"))
def interpolate_gap(spark, sf_dir):
    between = F.transform(K.between_frames(F.col("frame"), F.col("next"), F.lit(7)), lambda f: f["pose_keypoints_2d"])
    steps = pairs(spark, sf_dir).select("vec_id", F.posexplode(between).alias("k", "a")).withColumn("step", (F.col("k") + 1).cast("long"))
    return values(steps, F.col("a"), "vec_id", "step")


#: Plain blends of one array, for sequences of arrays.
def blend_arrays(a, b, n):
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: K.blend(a, b, i / (n + 1)))


def label_sequences(spark, sf_dir):
    """The vectors of each label as a sequence of body arrays."""
    rows = F.array_sort(F.collect_list(F.struct("vec_id", F.slice("v", 1, 27).alias("a"))))  # a recording
    return vector_frames(spark, sf_dir).groupBy("label").agg(F.transform(rows, lambda x: x["a"]).alias("pose_sequence"))


SEQUENCES = f"{VECTORS}, fr AS (SELECT label, v[1:27] AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM v), cnt AS (SELECT label, count(*) AS n FROM fr GROUP BY label)"


#: To twice the length and five more: n + 5 frames over n - 1 gaps.
@add(f"""WITH {SEQUENCES}, g AS (SELECT x.label, x.rn, x.a, y.a AS b, (n + 5) // (n - 1) + CASE WHEN x.rn - 1 < (n + 5) % (n - 1) THEN 1 ELSE 0 END AS k FROM fr x JOIN fr y ON x.label = y.label AND y.rn = x.rn + 1 JOIN cnt ON cnt.label = x.label),
parts AS (SELECT label, rn, 0 AS step, a FROM fr UNION ALL SELECT label, rn, step, {blend_sql('a', 'b', '(step / (k + 1))')} AS a FROM (SELECT *, unnest(range(1, k + 1)) AS step FROM g)),
o AS (SELECT CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY label ORDER BY rn, step) - 1 AS frame, a FROM parts) """ + rows("a", "label, frame", source="o"))
def stretch_even(spark, sf_dir):
    out = label_sequences(spark, sf_dir).select("label", F.posexplode(K.stretch("pose_sequence", F.size("pose_sequence") * 2 + 5, blend_arrays)).alias("f", "a")).withColumn("frame", F.col("f").cast("long"))
    return values(out, F.col("a"), "label", "frame")


@add(f"""WITH {SEQUENCES}, e AS (SELECT label, arg_max(a, rn) AS last, arg_min(a, rn) AS first FROM fr GROUP BY label), m AS (SELECT label, label * 40.0 AS igt, (9 - label) * 30.0 AS ogt FROM e),
j AS (SELECT e.label, e.first, lag(e.last) OVER (ORDER BY e.label) AS prev, CASE WHEN round_even(round_even((lag(m.ogt) OVER (ORDER BY e.label) + m.igt) / 2, 0) / 1000 * 50, 0) >= 1 THEN CAST(round_even(round_even((lag(m.ogt) OVER (ORDER BY e.label) + m.igt) / 2, 0) / 1000 * 50, 0) AS BIGINT) ELSE 7 END AS k FROM e JOIN m USING (label)),
parts AS (SELECT label, 1 AS part, rn AS step, a FROM fr UNION ALL SELECT label, 0, step, {blend_sql('prev', 'first', '(step / (k + 1))')} FROM (SELECT *, unnest(range(1, k + 1)) AS step FROM j WHERE prev IS NOT NULL)),
o AS (SELECT row_number() OVER (ORDER BY label, part, step) - 1 AS frame, a FROM parts) """ + rows("a", "frame", source="o"))
def stitch(spark, sf_dir):
    seqs = label_sequences(spark, sf_dir).select(F.lit(1).alias("query"), F.col("label").alias("pos"), F.col("label").cast("string").alias("gloss"), "pose_sequence")
    times = seqs.select("gloss", (F.col("pos") * 40.0).alias("median_igt"), ((9 - F.col("pos")) * 30.0).alias("median_ogt"))
    out = motion.stitch(seqs, times, blender=blend_arrays)
    return values(out.select(F.posexplode("pose_sequence").alias("f", "a")).withColumn("frame", F.col("f").cast("long")), F.col("a"), "frame")


@add(f"""WITH {VECTORS}, p AS (SELECT label, vec_id, unnest(v[1:63]) AS x, generate_subscripts(v[1:63], 1) AS i FROM v), l AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM p WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)),
j AS (SELECT label, vec_id, sum(pow(x - 3 * a + 3 * b - c, 2)) AS q FROM l WHERE c IS NOT NULL AND (i - 1) % 3 <> 2 GROUP BY label, vec_id) SELECT CAST(label AS INTEGER) AS label, round(avg(q), 6) AS msj FROM j GROUP BY label""")
def msj(spark, sf_dir):
    frames = vector_frames(spark, sf_dir).withColumn("xy", K.positions(F.col("frame")))
    return motion.mean_squared_jerk(frames, ["label"], "vec_id", "xy").select("label", r6("msj").alias("msj"))


#: Speeds as rows, and the spectral arc length from the sums of their Fourier transform.
SPEEDS = f"""{VECTORS}, p AS (SELECT label, vec_id, unnest(v[1:63]) AS x, generate_subscripts(v[1:63], 1) AS i FROM v), l AS (SELECT *, x - lag(x, 1) OVER (PARTITION BY label, i ORDER BY vec_id) AS d FROM p),
s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, sqrt(sum(d * d)) AS v FROM l WHERE d IS NOT NULL AND (i - 1) % 3 <> 2 GROUP BY label, vec_id)"""
ARC = f"""{SPEEDS}, m AS (SELECT label, count(*) AS m FROM s GROUP BY label), f AS (SELECT s.label, m, k, sqrt(pow(sum(v * cos(2 * pi() * k * t / m)), 2) + pow(sum(v * sin(2 * pi() * k * t / m)), 2)) AS size FROM s JOIN m ON s.label = m.label, range(0, 100000) r(k) WHERE k <= m // 2 GROUP BY s.label, m, k),
c AS (SELECT *, sum(size) OVER (PARTITION BY label ORDER BY k) / sum(size) OVER (PARTITION BY label) AS share FROM f), e AS (SELECT label, min(k) AS last FROM c WHERE share >= 0.99 GROUP BY label),
d AS (SELECT c.label, sqrt(pow(size - lag(size) OVER (PARTITION BY c.label ORDER BY k), 2) + pow(1.0 / m, 2)) AS step FROM c JOIN e ON c.label = e.label WHERE k <= last), arc AS (SELECT label, -sum(step) AS sal FROM d GROUP BY label)"""


@add(f"WITH {ARC} SELECT CAST(label AS INTEGER) AS label, round(coalesce(sal, 0), 6) + 0.0 AS sal FROM arc")
def sal(spark, sf_dir):
    frames = vector_frames(spark, sf_dir).withColumn("xy", K.positions(F.col("frame")))
    return motion.spectral_arc_length(frames, ["label"], "vec_id", "xy").select("label", r6("sal").alias("sal"))


JERK = """lj AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM p WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)),
jerk AS (SELECT label, avg(q) AS msj FROM (SELECT label, vec_id, sum(pow(x - 3 * a + 3 * b - c, 2)) AS q FROM lj WHERE c IS NOT NULL AND (i - 1) % 3 <> 2 GROUP BY label, vec_id) GROUP BY label)"""


@add(f"WITH {ARC}, {JERK} SELECT CAST(arc.label AS INTEGER) AS label, round(sal, 6) + 0.0 AS sal, round(msj, 6) + 0.0 AS msj FROM arc JOIN jerk ON arc.label = jerk.label WHERE sal IS NOT NULL")
def smoothness(spark, sf_dir):
    """Only sequences that have both figures."""
    frames = vector_frames(spark, sf_dir).withColumn("xy", K.positions(F.col("frame")))
    return motion.smoothness(frames, ["label"], "vec_id", "xy").select("label", r6("sal").alias("sal"), r6("msj").alias("msj"))


@add(f"WITH {VECTORS}, p AS (SELECT label, vec_id, unnest(v[1:63]) AS x, generate_subscripts(v[1:63], 1) AS i FROM v), l AS (SELECT *, x - lag(x, 1) OVER (PARTITION BY label, i ORDER BY vec_id) AS d FROM p), s AS (SELECT label, vec_id, sqrt(sum(d * d)) AS v FROM l WHERE (i - 1) % 3 <> 2 AND d IS NOT NULL GROUP BY label, vec_id) SELECT CAST(label AS INTEGER) AS label, count(*) AS steps, round(sum(v), 6) AS path FROM s GROUP BY label")
def speeds(spark, sf_dir):
    frames = vector_frames(spark, sf_dir).withColumn("xy", K.positions(F.col("frame")))
    s = motion.speeds(frames, ["label"], "vec_id", "xy")
    return s.select("label", F.size("speeds").cast("long").alias("steps"), r6(F.aggregate("speeds", F.lit(0.0), lambda a, x: a + x)).alias("path"))


@add("WITH q AS (SELECT vec_id AS q_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id AS t_id, list_cosine_similarity(list_transform(e, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS sim FROM q, embeddings WHERE vec_id <> q_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, t_id) AS n FROM s) SELECT q_id, t_id, round(sim, 6) AS similarity, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3")
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = matching.nearest_cosine(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), e.withColumnRenamed("vec_id", "t_id"), 3, skip_self=True)
    return found.select("q_id", "t_id", r6("similarity").alias("similarity"), "rank")


@add(f"WITH {VECTORS} SELECT vec_id, CAST(count(*) AS BIGINT) AS sure FROM (SELECT vec_id, unnest(range(21)) AS p, v FROM v) WHERE v[3 * p + 3] > 0.01 AND v[3 * p + 1] > 0 AND v[3 * p + 2] > 0 GROUP BY vec_id")
def sure_points(spark, sf_dir):
    kept = K.drop_unsure(K.triples(F.slice("v", 1, 63)))
    n = F.size(F.filter(kept, lambda p: p["score"] > 0)).cast("long")
    return vector_frames(spark, sf_dir).select("vec_id", n.alias("sure")).where("sure > 0")


@add(f"WITH {VECTORS} SELECT vec_id, CAST(p AS BIGINT) AS id, round(CASE WHEN p = 8 THEN 0.5 ELSE v[3 * p + 1] + (0.5 - v[4]) END, 6) + 0.0 AS x, round(CASE WHEN p = 8 THEN 0.8 ELSE v[3 * p + 2] + (0.4 - v[5]) END, 6) + 0.0 AS y FROM (SELECT vec_id, v, unnest(range(9)) AS p FROM v)")
def recentre(spark, sf_dir):
    body = K.triples(F.slice("v", 1, 27))
    out = vector_frames(spark, sf_dir).select("vec_id", F.explode(K.recentre(body, body, fix_hip=True)).alias("p"))
    return out.select("vec_id", F.col("p.id").cast("long").alias("id"), r6("p.x").alias("x"), r6("p.y").alias("y"))


@add("WITH l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT label, CASE WHEN label % 3 <> 0 THEN label * 300.0 END AS gd FROM l) SELECT count(*) FILTER (n * 20 < gd) AS needs, count(*) FILTER (gd IS NULL) AS skipped, count(gd) AS checked, round(count(*) FILTER (n * 20 < gd) * 100.0 / count(gd), 6) AS percent FROM l JOIN t USING (label)")
def needs_stretching(spark, sf_dir):
    lengths = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("gloss")).agg(F.count(F.lit(1)).alias("n_frames"))
    times = lengths.where(F.col("gloss").cast("int") % 3 != 0).select("gloss", (F.col("gloss").cast("int") * 300.0).alias("median_gd"))
    return D.needs_stretching(lengths, times).withColumn("percent", r6("percent"))


