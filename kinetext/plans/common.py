"""What the registered queries share: tables, views over the supplied ones, and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with the SQL that checks them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer splits than the cluster has cores, dealt out evenly; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r6(c: Column | str) -> Column:
    """Six places, without a negative zero; in SQL ``round(x, 6) + 0.0``."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks: a user is an entry, a signup a sentence, the value a duration."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entry"), F.when(F.col("event_id") % 3 == 0, "B").otherwise("A").alias("speaker"), F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("block_index"), F.col("event_type").alias("text"), F.col("event_type").alias("gloss"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 240000).cast("long")).alias("end_ms"), (F.col("event_type") == "signup").alias("is_full"),
    )


BLOCKS = """b AS (SELECT user_id AS entry, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS speaker, event_id AS pos, CAST(event_id AS VARCHAR) AS block_index,
  event_type AS text, event_type AS gloss, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 240000) AS BIGINT) AS end_ms, event_type = 'signup' AS is_full FROM events)"""
MARKED = f"""{BLOCKS},
m0 AS (SELECT *, sum(CASE WHEN is_full THEN 1 ELSE 0 END) OVER (PARTITION BY entry, speaker ORDER BY pos) AS s0 FROM b),
m1 AS (SELECT *, max(CASE WHEN is_full THEN end_ms END) OVER (PARTITION BY entry, speaker, s0) AS se FROM m0),
m2 AS (SELECT *, s0 > 0 AND NOT coalesce(bool_or(start_ms > se AND NOT is_full) OVER (PARTITION BY entry, speaker, s0 ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS inside FROM m1),
m AS (SELECT entry, speaker, pos, block_index, text, gloss, start_ms, end_ms, is_full, inside AND NOT coalesce(lead(inside) OVER (PARTITION BY entry, speaker, s0 ORDER BY pos), false) AS is_end FROM m2)"""
LOST = f"""{MARKED},
l0 AS (SELECT *, sum(CASE WHEN is_full AND NOT is_end THEN 1 ELSE 0 END) OVER (PARTITION BY entry, speaker ORDER BY pos) AS sid FROM m),
l AS (SELECT *, NOT is_full AND NOT is_end AND coalesce(bool_or(is_end) OVER (PARTITION BY entry, speaker, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lost FROM l0)"""
TIMES = f"""{LOST},
f AS (SELECT *, end_ms - start_ms AS gd, count(*) OVER (PARTITION BY entry, speaker, sid, lost) AS n_main FROM l WHERE NOT is_full OR is_end),
g AS (SELECT entry, speaker, sid, start_ms, end_ms, min(pos) AS first, arg_min(block_index, pos) AS spot, bool_or(is_end) AS x FROM f WHERE NOT lost GROUP BY ALL),
h AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lag(spot) OVER w AS pa, lead(spot) OVER w AS na FROM g WINDOW w AS (PARTITION BY entry, speaker, sid ORDER BY start_ms, first)),
k AS (SELECT *, coalesce(greatest(0, start_ms - pe), 0) AS igt, CASE WHEN x OR ns IS NULL THEN 0 ELSE greatest(0, ns - end_ms) END AS ogt, CASE WHEN x OR ns IS NULL THEN NULL ELSE na END AS nx FROM h),
t AS (SELECT f.entry, f.speaker, f.pos, f.block_index, f.gloss, f.gd,
  CASE WHEN f.lost OR n_main = 1 THEN 0 ELSE k.igt END AS igt, CASE WHEN f.lost OR n_main = 1 THEN 0 ELSE k.ogt END AS ogt,
  CASE WHEN f.lost OR n_main = 1 THEN f.block_index ELSE coalesce('index:' || pa || '-' || spot, 'None') END AS igt_index,
  CASE WHEN f.lost OR n_main = 1 THEN f.block_index ELSE coalesce('index:' || spot || '-' || nx, 'None') END AS ogt_index,
  CASE WHEN f.lost OR n_main = 1 THEN f.block_index WHEN pa IS NULL AND nx IS NULL THEN spot ELSE 'IGT:' || coalesce(pa || '-' || spot, 'None') || ' | OGT:' || coalesce(spot || '-' || nx, 'None') END AS tgt_index, f.lost
  FROM f LEFT JOIN k ON f.entry = k.entry AND f.speaker = k.speaker AND f.sid = k.sid AND f.start_ms = k.start_ms AND f.end_ms = k.end_ms),
tt AS (SELECT *, igt + gd + ogt AS tgt FROM t)"""

#: A frame from a vector: 21 points, of which the first nine are the body.
PARTS = {"pose_keypoints_2d": (1, 27), "face_keypoints_2d": (28, 12), "hand_left_keypoints_2d": (40, 12), "hand_right_keypoints_2d": (52, 12)}


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pose frames: the label is the sequence, the id the order."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"), F.struct(*(F.slice(v, a, n).alias(k) for k, (a, n) in PARTS.items())).alias("frame"))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def values(df: DataFrame, arr: Column, *keys: str) -> DataFrame:
    """An array as rows (keys, i, value)."""
    return df.select(*keys, F.posexplode(arr).alias("i", "x")).select(*keys, long("i").alias("i"), r6("x").alias("value"))
