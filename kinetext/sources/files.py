"""Tables, keypoint documents and plain lists from files, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .srt import ENTRY


def csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """A headered CSV with quoted line breaks; columns by name, in the order of the schema."""
    want = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    text = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    return text.select(*(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in want))


def first_column(spark: SparkSession, path: str, name: str = "gloss") -> DataFrame:
    """Distinct trimmed values of a CSV's first column, without the header."""
    df = spark.read.csv(path, header=True, escape='"')
    return df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias(name)).where(F.col(name) != "").distinct()


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(entry, camera_no, cam) of keypoint documents, with the fixed schema: other keys are never parsed."""
    doc = T.ArrayType(schemas.CAMERA)
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", ENTRY, 1).alias("entry"), F.from_json("value", doc).alias("doc"))
    return text.select("entry", F.posexplode("doc").alias("camera_no", "cam"))


def pose_items(spark: SparkSession, path: str, schema: T.StructType = schemas.POSE_FILE) -> DataFrame:
    """The items of ``{"data": [...]}`` documents; malformed files are left out. ``item_no`` orders them within a file."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.posexplode("data").alias("item_no", "item")).select("path", "item_no", "item.*")


def pose_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(gloss, pose_sequence) of a document that maps glosses to sequences."""
    kind = T.MapType(T.StringType(), T.ArrayType(schemas.PERSON))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("gloss", "pose_sequence"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDING).parquet(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of files, from the listing."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where(F.col("term") != "")


def literal_items(text: Column, upper: bool = True) -> Column:
    """An array of (pos, gloss) of a comma-separated list; blank items are dropped, the others numbered from 1. Null gives none."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("pos"), (F.upper(x) if upper else x).alias("gloss")))


def literal_list(spark: SparkSession, text: str, upper: bool = True) -> DataFrame:
    """(pos, gloss) of one such list."""
    return spark.range(1).select(F.inline(literal_items(F.lit(text), upper)))


def from_entry(df: DataFrame, first: str) -> DataFrame:
    """Entries from one on, in the order of their numbers."""
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    return df.where(number(F.col("entry")) >= number(F.lit(first)))


def with_suffix_unioned(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Several CSV files, each with its header, as one table; a path without files is skipped."""
    out = None
    for p in paths:
        try:
            part = csv(spark, p, schema)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, by: Sequence[str] = (), sep: str = ",") -> None:
    writer = df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("sep", sep)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One document per line; letters beyond ASCII stay as they are."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def grouped_report(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, value): a heading and its distinct items, sorted, one a line."""
    items = F.array_sort(F.collect_set(item))
    return df.groupBy(key).agg(F.concat(F.col(key), F.lit(":\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).alias("value"))


def render_config(df: DataFrame, template: str, columns: Sequence[str]) -> DataFrame:
    """``config``: the template with its %s filled from columns."""
    return df.withColumn("config", F.format_string(template, *columns))


def clip_plan(matches: DataFrame, path: Column, start: Column, duration: Column, name: Column) -> DataFrame:
    """(path, start, duration, out_name) of clips to be cut by a video tool; clips without length are left out."""
    return matches.select(path.alias("path"), start.alias("start"), duration.alias("duration"), name.alias("out_name")).where("duration > 0")
