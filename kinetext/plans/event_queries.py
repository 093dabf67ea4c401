"""Queries of segmentation, timing and interval joins, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dictionary as D
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import segments as S
from ..operators import timing as M
from .common import BLOCKS, LOST, MARKED, TIMES, Registry, event_blocks, long, r6, table

R = Registry()
add = R.add


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gloss_times(S.mark_sentences(event_blocks(spark, sf_dir)))


def rounded(df: DataFrame) -> DataFrame:
    """Statistics of times in ms, to hundredths."""
    return df.select(*((F.round(c, 2) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


STATS = ", ".join(f"round(avg({m}), 2) + 0.0 AS avg_{m}, round(median({m}), 2) + 0.0 AS median_{m}, round(stddev_samp({m}), 2) + 0.0 AS std_{m}" for m in M.METRICS)


@add(f"WITH {TIMES} SELECT gloss, {STATS}, count(*) AS count FROM tt GROUP BY gloss")
def gloss_time_metrics(spark, sf_dir):
    return rounded(M.statistics(times(spark, sf_dir), ["gloss"]))


@add(f"WITH {TIMES} SELECT entry, block_index, speaker, gloss, gd, igt, ogt, tgt, igt_index, ogt_index, tgt_index, lost FROM tt")
def gloss_times_raw(spark, sf_dir):
    return times(spark, sf_dir).select("entry", "block_index", "speaker", "gloss", "gd", "igt", "ogt", "tgt", "igt_index", "ogt_index", "tgt_index", "lost")


@add(f"WITH {TIMES}, u AS (SELECT unnest(['gd', 'igt', 'ogt', 'tgt']) AS metric, unnest([gd, igt, ogt, tgt]) AS v FROM tt) SELECT metric, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS median, round(stddev_samp(v), 2) AS std, round(quantile_cont(v, 0.25), 2) AS q25, round(quantile_cont(v, 0.75), 2) AS q75 FROM u GROUP BY metric")
def gloss_time_global(spark, sf_dir):
    return rounded(M.global_statistics(times(spark, sf_dir)))


@add(f"WITH {TIMES}, s AS (SELECT gloss, " + ", ".join(f"round(avg({m}), 2) + 0.0 AS avg_{m}, round(median({m}), 2) + 0.0 AS median_{m}" for m in M.METRICS) + " FROM tt GROUP BY gloss) SELECT tt.pos, tt.gloss, gd, igt, ogt, tgt, s.* EXCLUDE (gloss) FROM tt JOIN s ON tt.gloss = s.gloss")
def occurrence_with_group_stats(spark, sf_dir):
    out = M.with_group_statistics(times(spark, sf_dir), ["gloss"])
    return rounded(out.select("pos", "gloss", *M.METRICS, *(f"{n}_{m}" for m in M.METRICS for n in ("avg", "median"))))


@add(f"WITH {TIMES} SELECT gloss, entry, block_index, speaker, gd FROM tt WHERE gd > 20000000")
def metric_threshold_outliers(spark, sf_dir):
    return M.threshold(times(spark, sf_dir), "gd", 20_000_000, columns=["gloss", "entry", "block_index", "speaker", "gd"], ties=["pos"])


@add(f"WITH {TIMES} SELECT gloss, round(avg(gd), 2) AS avg_gd FROM tt WHERE NOT lost GROUP BY gloss ORDER BY avg(gd) DESC, gloss LIMIT 3")
def top_glosses_by_duration(spark, sf_dir):
    return rounded(M.extremes(M.statistics(times(spark, sf_dir).where("not lost"), ["gloss"], ["gd"]), "avg_gd", 3, ties=["gloss"]).select("gloss", "avg_gd"))


@add(f"WITH {TIMES} SELECT pos, gloss, tgt FROM tt ORDER BY tgt DESC, pos LIMIT 10")
def top10_occurrences(spark, sf_dir):
    return M.extremes(times(spark, sf_dir), "tgt", 10, ties=["pos"]).select("pos", "gloss", "tgt")


@add(f"WITH {TIMES} SELECT pos, gloss, gd FROM tt ORDER BY gd, pos LIMIT 10")
def bottom10_occurrences(spark, sf_dir):
    return M.extremes(times(spark, sf_dir), "gd", 10, largest=False, ties=["pos"]).select("pos", "gloss", "gd")


@add(f"WITH {TIMES} SELECT gloss, round(median(gd) * 50 / 1000, 6) AS frames FROM tt GROUP BY gloss")
def median_frames(spark, sf_dir):
    out = M.statistics(times(spark, sf_dir), ["gloss"], ["gd"])
    return out.select("gloss", r6(M.to_frames("median_gd")).alias("frames"))


DAYS = "b AS (SELECT user_id AS entry, event_id AS pos, event_type = 'signup' AS is_full, epoch_us(date_trunc('day', ts)) // 1000 AS start_ms, epoch_us(date_trunc('day', ts)) // 1000 + 86400000 AS end_ms FROM events)"


@add(f"""WITH {DAYS}, w AS (SELECT *, row_number() OVER x AS rn, is_full AND NOT lag(is_full) OVER x AND lag(start_ms) OVER x = start_ms AND lag(end_ms) OVER x = end_ms AS sf,
 NOT is_full AND lead(is_full) OVER x AND lead(start_ms) OVER x = start_ms AND lead(end_ms) OVER x = end_ms AS sg FROM b WINDOW x AS (PARTITION BY entry ORDER BY pos))
SELECT entry, pos, is_full, CASE WHEN sf THEN greatest(0, start_ms - 1) ELSE start_ms END AS start_ms, end_ms, CASE WHEN sf THEN rn - 1 WHEN sg THEN rn + 1 ELSE rn END AS sort_key FROM w""")
def adjacent_swap(spark, sf_dir):
    start = (F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))) / 1000).cast("long")
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), F.col("event_id").alias("pos"), (F.col("event_type") == "signup").alias("is_full"), start.alias("start_ms"), (start + 86_400_000).alias("end_ms"))
    return S.swap_adjacent(days, ["entry"]).withColumn("sort_key", long("sort_key"))


@add(f"WITH {MARKED} SELECT entry, speaker, pos, is_full, is_end FROM m")
def session_marking(spark, sf_dir):
    return S.mark_sentences(event_blocks(spark, sf_dir)).select("entry", "speaker", "pos", "is_full", "is_end")


@add(f"WITH {MARKED}, q AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY entry, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM m) SELECT entry, speaker, pos, group_id, bool_or(is_end) OVER (PARTITION BY entry, speaker, group_id) AS is_group FROM q")
def end_groups(spark, sf_dir):
    return S.end_groups(S.mark_sentences(event_blocks(spark, sf_dir))).select("entry", "speaker", "pos", long("group_id").alias("group_id"), "is_group")


@add(f"WITH {LOST} SELECT entry, speaker, pos, lost FROM l")
def lost_flags(spark, sf_dir):
    return S.lost_flags(S.mark_sentences(event_blocks(spark, sf_dir))).select("entry", "speaker", "pos", "lost")


#: Event types stand for single tokens (error) and vetoes (purchase).
EXCLUDE = {"excluded": ["error"], "veto": ["purchase"], "prefix": "purchase"}


@add(f"""WITH {MARKED}, q AS (SELECT *, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY entry, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gid FROM m),
q2 AS (SELECT *, bool_or(is_end) OVER (PARTITION BY entry, speaker, gid) AS is_group FROM q),
q3 AS (SELECT *, bool_or(text = 'purchase') OVER (PARTITION BY entry, speaker, gid) AS veto, row_number() OVER (PARTITION BY entry, speaker, gid ORDER BY pos DESC) = 1 AS last FROM q2 WHERE text <> 'error')
SELECT entry, speaker, pos, text, is_group AND last AS is_end FROM q3 WHERE CASE WHEN is_group THEN NOT veto ELSE text <> 'purchase' END""")
def exclusion(spark, sf_dir):
    return S.exclude(S.mark_sentences(event_blocks(spark, sf_dir)), **EXCLUDE).select("entry", "speaker", "pos", "text", "is_end")


@add(f"""WITH {LOST}, p AS (SELECT *, coalesce(bool_or(is_end) OVER (PARTITION BY entry, speaker, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended, bool_or(is_end) OVER (PARTITION BY entry, speaker, sid) AS complete FROM l)
SELECT entry, speaker, CAST(sid AS BIGINT) AS sid, max(start_ms) FILTER (is_full) AS start_ms, coalesce(string_agg(text, ',' ORDER BY pos) FILTER (NOT is_full), '') AS glosses FROM p WHERE sid > 0 AND NOT ended AND complete GROUP BY entry, speaker, sid""")
def sentence_glosses(spark, sf_dir):
    return S.sentence_pairs(S.mark_sentences(event_blocks(spark, sf_dir))).select("entry", "speaker", long("sid").alias("sid"), "start_ms", "glosses")


CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@add(f"WITH d AS (SELECT event_id, CAST(epoch_us(ts) // 1000 % 86400000 AS BIGINT) AS ms FROM events) SELECT event_id, {CLOCK.format('ms')} AS clock, ms FROM d")
def srt_roundtrip(spark, sf_dir):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") % 86_400_000
    out = table(spark, sf_dir, "events").select("event_id", X.ms_to_clock(ms).alias("clock"))
    return out.withColumn("ms", X.srt_to_ms("clock"))


@add(f"WITH {BLOCKS} SELECT pos, start_ms, least(end_ms, start_ms + 2000) AS end_ms FROM b")
def duration_cap(spark, sf_dir):
    return event_blocks(spark, sf_dir).select("pos", "start_ms", X.cap_end("start_ms", "end_ms").alias("end_ms"))


@add("WITH d AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events) SELECT event_id, CAST(trunc(ms / 1000 * 50) AS INTEGER) AS frame, CAST(round_even(ms / 1000 * 50, 0) AS INTEGER) AS rounded FROM d")
def ms_to_frames(spark, sf_dir):
    ms = F.floor(F.col("value") * 1000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", X.ms_to_frame(ms).alias("frame"), X.ms_to_frames_rounded(ms).alias("rounded"))


@add("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS n FROM events WHERE event_type = 'click') WHERE n % 10 = 0")
def every_10th(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    return S.every_nth(clicks, 10, "user_id", "event_id").select("event_id", "user_id")


def _touch(spark, sf_dir, semi):
    b = event_blocks(spark, sf_dir).withColumn("start_ms", F.floor(F.col("start_ms") / 3_600_000)).withColumn("end_ms", F.floor(F.col("end_ms") / 3_600_000))
    outliers = b.where("end_ms - start_ms > 5").select("entry", "speaker", "block_index")
    return J.touching_blocks(outliers, b, b, semi=semi).select("entry", "speaker", "block_index")


TOUCH = f"""WITH {BLOCKS}, h AS (SELECT entry, speaker, block_index, text, start_ms // 3600000 AS s, end_ms // 3600000 AS e FROM b)
SELECT entry, speaker, block_index FROM h a WHERE e - s > 5 AND {{}} EXISTS (SELECT 1 FROM h o WHERE o.entry = a.entry AND (o.s = a.e OR o.e = a.e) AND NOT (o.s = a.s AND o.e = a.e) AND o.text <> a.text)"""


@add(TOUCH.format(""))
def exists_theta_semi(spark, sf_dir):
    return _touch(spark, sf_dir, True)


@add(TOUCH.format("NOT"))
def exists_theta_anti(spark, sf_dir):
    return _touch(spark, sf_dir, False)


@add(f"WITH {BLOCKS} SELECT f.entry, f.pos, count(*) AS overlapping, min(s.pos) AS first FROM b f JOIN b s ON f.entry = s.entry AND s.start_ms < f.end_ms AND s.end_ms > f.start_ms WHERE f.text = 'error' AND s.is_full GROUP BY f.entry, f.pos")
def interval_overlap(spark, sf_dir):
    b = event_blocks(spark, sf_dir)
    right = b.where("is_full").select("entry", F.col("pos").alias("s_pos"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    pairs = I.overlaps(b.where("text = 'error'").select("entry", "pos", "start_ms", "end_ms"), right, ["entry"], ("start_ms", "end_ms"), ("s_start", "s_end"))
    return pairs.groupBy("entry", "pos").agg(F.count(F.lit(1)).alias("overlapping"), F.min("s_pos").alias("first"))


@add(f"WITH {BLOCKS}, p AS (SELECT entry, pos, start_ms - 15000 AS p FROM b WHERE text = 'click') SELECT p.entry, p.pos, coalesce((SELECT arg_min(start_ms, struct_pack(a := speaker, o := pos)) FROM b s WHERE s.is_full AND s.entry = p.entry AND s.start_ms <= p.p AND p.p < s.end_ms), p.p) AS snapped FROM p")
def snap_start(spark, sf_dir):
    b = event_blocks(spark, sf_dir)
    points = b.where("text = 'click'").select("entry", "pos", (F.col("start_ms") - 15_000).alias("p"))
    full = b.where("is_full").select("entry", F.col("speaker").alias("a"), F.col("pos").alias("o"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return I.snap_to_interval(points, full, ["entry"], ["entry", "pos"], "p", "s", "e", ["a", "o"]).select("entry", "pos", "snapped")


@add(f"""WITH {BLOCKS}, iv AS (SELECT entry, pos, CAST(start_ms // 3600000 AS BIGINT) AS f0, CAST(least(end_ms, start_ms + 86400000) // 3600000 AS BIGINT) AS f1 FROM b WHERE is_full),
fr AS (SELECT entry, pos AS item, CAST(start_ms // 3600000 AS BIGINT) AS frame FROM b WHERE NOT is_full)
SELECT iv.entry, iv.pos, coalesce(string_agg(CAST(item AS VARCHAR), ',' ORDER BY frame, item), '') AS items FROM iv LEFT JOIN fr ON iv.entry = fr.entry AND frame BETWEEN f0 AND f1 GROUP BY iv.entry, iv.pos""")
def range_join_collect(spark, sf_dir):
    b = event_blocks(spark, sf_dir)
    hour = lambda c: F.floor(c / 3_600_000).cast("long")
    iv = b.where("is_full").select("entry", "pos", hour(F.col("start_ms")).alias("f0"), hour(X.cap_end("start_ms", "end_ms", 86_400_000)).alias("f1"))
    fr = b.where("not is_full").select("entry", F.col("pos").alias("item"), hour(F.col("start_ms")).alias("frame"))
    hits = I.frames_in_intervals(iv, fr, ["entry"], "f0", "f1", "frame", ["entry", "pos"])
    items = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("frame", "item"))))
    return hits.groupBy("entry", "pos").agg(F.array_join(F.transform(items, lambda x: x["item"].cast("string")), ",").alias("items"))


@add("""WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS n FROM events)
SELECT event_id, event_type || CASE WHEN n > 1 THEN printf('_%03d', n) ELSE '' END AS out_name, CAST(n AS INTEGER) AS occurrence FROM o""")
def occurrence_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.occurrence_names(e, "event_type", F.col("event_type"), "user_id", "event_id").select("event_id", "out_name", "occurrence")


@add("""WITH d AS (SELECT event_id, upper(event_type) || '||' || event_type AS g FROM events) SELECT event_id, CAST(unnest([0, 1]) AS INTEGER) AS subpos, 'A: ' || unnest(string_split(g, '||')) AS text FROM d""")
def dual_split(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("A: "), F.upper("event_type"), F.lit("||"), F.col("event_type")).alias("text"))
    return S.split_dual(lines).select("event_id", "subpos", "text")


@add("SELECT count(*) FILTER (g LIKE '%||%' AND g NOT LIKE '%_FULL_SENTENCE' AND upper(g) = g AND lower(g) <> g) AS dual, count(*) FILTER (g LIKE '%||%' AND upper(g) = g AND lower(g) <> g AND g LIKE '%ERROR%') AS dual_excluded FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '||X' AS g FROM events)")
def dual_gloss_counts(spark, sf_dir):
    g = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit("||X")).alias("g"))
    dual = F.col("g").contains("||") & ~F.endswith("g", F.lit(X.FULL)) & X.is_upper("g")
    return g.agg(F.count_if(dual).alias("dual"), F.count_if(dual & F.col("g").contains("ERROR")).alias("dual_excluded"))


@add("SELECT CAST(p_partkey AS INTEGER) AS number, CAST(v AS INTEGER) AS variant, CAST((v - 1) // 6 + 1 AS BIGINT) AS batch FROM part, range(1, 11) b(v)")
def variants_cartesian(spark, sf_dir):
    numbers = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("number"))
    return numbers.select("number", F.explode(J.variants(0)).alias("x")).select("number", "x.*")


@add(f"WITH {BLOCKS} SELECT entry, pos, CAST(trunc(start_ms % 86400000 / 1000 * 50) AS INTEGER) AS first_frame, CAST(trunc((end_ms - start_ms) / 1000 * 50) AS INTEGER) AS last_frame FROM b WHERE NOT is_full")
def gloss_frames(spark, sf_dir):
    """Glosses in frames of their day; sentences left out."""
    day = event_blocks(spark, sf_dir).withColumns({"start_ms": F.col("start_ms") % 86_400_000, "end_ms": F.col("end_ms") - F.col("start_ms")})
    return D.intervals_in_frames(day).select("entry", "pos", "first_frame", "last_frame")


@add(f"WITH {BLOCKS} SELECT entry, speaker, pos, CAST(row_number() OVER (PARTITION BY entry, speaker ORDER BY end_ms DESC, pos) AS INTEGER) AS block_idx FROM b")
def renumbered(spark, sf_dir):
    last_first = event_blocks(spark, sf_dir).withColumn("back", -F.col("end_ms"))
    return S.renumber(last_first, S.KEYS, "back", "pos").select("entry", "speaker", "pos", "block_idx")
