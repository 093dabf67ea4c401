"""Large nested JSON documents, scanned in parts.

A document is cut into blocks of bytes, whatever its lines. A first pass finds
for each block how many quotes it holds and by how much it changes the depth,
both for a start inside and outside of a string; running sums then say in which
state each block starts. A second pass finds the borders of the items at a given
depth, and gives a row an item. An item belongs to the block in which it starts,
whose task reads on to its end; no document is ever in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .scratch import materialize
from .srt import ENTRY

#: Bytes of a block, and of what is read on beyond it at a time.
BLOCK, CHUNK = 4 << 20, 1 << 20
QUOTE, BACKSLASH, COMMA = b'"\\,'
OPEN, CLOSE = b"{[", b"}]"

Read = Callable[[int, int], bytes]


def opened(path: str) -> Read:
    """A reader of bytes from a place on."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    fs, name = pafs.FileSystem.from_uri(uri)
    source = fs.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read


def escapes_before(read: Read, at: int) -> int:
    """How many backslashes stand directly before a place."""
    n = 0
    while at > 0:
        data = read(max(0, at - 4096), min(4096, at))
        own = len(data) - len(data.rstrip(b"\\"))
        n, at = n + own, at - len(data)
        if own < len(data):
            break
    return n


@dataclass
class State:
    """Where a scan is: inside a string, how deep, and the backslashes just read."""

    quoted: int
    depth: int
    escapes: int


def _strings(b: np.ndarray, state: State) -> tuple[np.ndarray, int]:
    """For each byte whether a string is open before it, counting from the state; the backslashes at the end."""
    slash = b == BACKSLASH
    quote = b == QUOTE
    escapes = 0
    if len(b) and (state.escapes or slash.any()):
        place = np.arange(len(b), dtype=np.int32)
        other = np.maximum.accumulate(np.where(slash, -1, place))
        run = np.concatenate([[state.escapes], np.where(other < 0, place + 1 + state.escapes, place - other)])  # backslashes before each byte
        quote &= run[:-1] % 2 == 0
        escapes = int(run[-1])
    before = np.cumsum(quote, dtype=np.int32) - quote
    state.quoted += int(quote.sum())
    return before, escapes


def _steps(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and commas, and by how much each changes the depth."""
    at = np.flatnonzero(np.isin(b, np.frombuffer(OPEN + CLOSE + b",", np.uint8)))
    return at, np.isin(b[at], np.frombuffer(OPEN, np.uint8)).astype(np.int64) - np.isin(b[at], np.frombuffer(CLOSE, np.uint8))


def summary(data: bytes, escapes: int) -> tuple[int, int, int]:
    """Quotes of a block (odd or even), and its change of depth if it starts outside and inside of a string."""
    b, state = np.frombuffer(data, np.uint8), State(0, 0, escapes)
    before, _ = _strings(b, state)
    at, step = _steps(b)
    inside = before[at] % 2 == 1
    return state.quoted % 2, int(step[~inside].sum()), int(step[inside].sum())


def borders(data: bytes, state: State, depth: int) -> list[tuple[int, int, int]]:
    """(place, step, level) of brackets and commas at ``depth`` and the level above; moves the state on. A bracket's level is that inside of it."""
    b = np.frombuffer(data, np.uint8)
    quoted = state.quoted % 2
    before, state.escapes = _strings(b, state)
    at, step = _steps(b)
    outside = (before[at] + quoted) % 2 == 0
    at, step = at[outside], step[outside]
    level = state.depth + np.cumsum(step)
    state.depth = int(level[-1]) if len(level) else state.depth
    level = level - np.minimum(step, 0)
    wanted = (level == depth) | (level == depth - 1)
    return list(zip(at[wanted].tolist(), step[wanted].tolist(), level[wanted].tolist(), strict=True))


def items(read: Read, start: int, end: int, state: State, depth: int) -> Iterator[tuple]:
    """(level, place, text, opener, outer, inner) of the items that start in a block, and at last a row of level -1.

    ``opener`` is where the bracket stands that an item of the upper level opens
    (its text is then only the key), ``outer`` and ``inner`` where the item's
    brackets of the upper and the lower level do (None: in an earlier block).
    """
    at, base, held, open_item = start, start, b"", None
    outer = inner = None
    while at < end or open_item:
        chunk = read(at, end - at if at < end else CHUNK)
        if not chunk:
            break  # the document ends within an item
        found = [(at + p, step, level) for p, step, level in borders(chunk, state, depth)]
        held, at = held + chunk, at + len(chunk)
        for p, step, level in found:
            if open_item:
                begin, own = open_item
                text = held[begin - base : p - base].decode("utf-8", "replace").strip()
                key = step > 0 and own == depth - 1
                if text or key:
                    yield own, begin, text, p if key else None, outer, inner if own == depth else None
                open_item = None
            if p >= end:
                yield -1, end, "", None, outer, inner
                return
            if step > 0:
                outer, inner = (p, inner) if level == depth - 1 else (outer, p)
            if step >= 0:
                open_item = (p + 1, level)
        keep = open_item[0] if open_item else at
        held, base = held[keep - base :], keep
    yield -1, end, "", None, outer, inner


ITEM = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("opener", "outer", "inner"))])
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def parts(spark: SparkSession, path: str, depth: int, block: int | None = None) -> DataFrame:
    """The items at ``depth`` of JSON documents (1: those of the outermost bracket), and those of the level above that hold no others.

    Columns path, level, place, text (an item as written: with its key, in an
    object), opener, outer and inner (see ``items``). Blocks have ``block``
    bytes. A document that ends early gives the items that are whole.
    """
    size = BLOCK if block is None else block
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    blocks = materialize(blocks.select("path", "block", (F.col("block") * size).alias("start"), F.least((F.col("block") + 1) * size, "length").alias("end")))
    tasks = max(1, min(blocks.count(), 100_000))  # a row is megabytes to read, so tasks are counted by rows

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                read = opened(p)
                rows.append(summary(read(start, end - start), escapes_before(read, start)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 3))], names=[*batch.schema.names, "quotes", "outside", "inside"])

    by = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block of one document
    counted = materialize(blocks.repartition(tasks, "path", "block").mapInArrow(summed, "path string, block long, start long, end long, quotes long, outside long, inside long"))
    known = counted.withColumn("quoted", F.coalesce(F.sum("quotes").over(by), F.lit(0)) % 2)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))).over(by), F.lit(0)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, no, start, end, quoted, deep in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "start", "end", "quoted", "depth")), strict=True):
                read, rows, held = opened(p), [], 0
                for item in items(read, start, end, State(quoted, deep, escapes_before(read, start)), depth):
                    rows.append((p, no, *item))
                    held += len(item[2])
                    if held > BLOCK:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    got = materialize(known.select("path", "block", "start", "end", "quoted", "depth").repartition(tasks, "path", "block").mapInArrow(found, ITEM))
    # What a block leaves open goes on in the next one.
    last = lambda c: F.last(c, ignorenulls=True).over(by).alias(f"{c}_before")
    before = got.where("level = -1").select("path", "block", last("outer"), last("inner"))
    out = got.where("level >= 0").join(before, ["path", "block"])
    inner = F.when(F.col("level") == depth, F.coalesce("inner", "inner_before"))
    return out.select("path", "level", "place", "text", "opener", F.coalesce("outer", "outer_before").alias("outer"), inner.alias("inner"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(KINDS), KINDS, strict=True)], names=ITEM.names)


def _pair(text, kind: T.DataType):
    """Key and value of an object's item."""
    return F.map_entries(F.from_json(F.concat(F.lit("{"), text, F.lit("}")), T.MapType(T.StringType(), kind)))[0]


def camera_frames(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """A row for each frame of keypoint documents: entry, camera_no, camera, width, height, frame (its key) and body, of the fixed schema."""
    found = parts(spark, path, 3, block)
    heads = found.where("level = 2 AND opener IS NULL").groupBy("path", "outer").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("text"), ","), F.lit("}")).alias("head"))  # a camera's few values
    told = T.StructType([f for f in schemas.CAMERA.fields if f.name != "frames"])
    heads = heads.withColumn("cam", F.from_json("head", told)).select("path", "outer", "cam.*")
    holders = found.where(F.col("opener").isNotNull() & F.col("text").rlike(r'^"frames"\s*:$')).select("path", F.col("opener").alias("inner"), "outer")
    every = found.where("outer IS NOT NULL").select("path", "outer").distinct()
    order = every.groupBy("path").agg(F.array_sort(F.collect_set("outer")).alias("all"))  # a document's cameras
    frames = found.where("level = 3").select("path", "inner", _pair(F.col("text"), schemas.FRAME).alias("x"))
    cameras = holders.join(heads, ["path", "outer"], "left").join(order, "path")
    cameras = cameras.select("path", "inner", (F.array_position("all", F.col("outer")) - 1).cast("int").alias("camera_no"), "camera", "width", "height")
    rows = frames.where("x IS NOT NULL").join(cameras, ["path", "inner"])
    return rows.select(F.regexp_extract("path", ENTRY, 1).alias("entry"), "camera_no", "camera", "width", "height", F.col("x.key").alias("frame"), F.col("x.value").alias("body"))


def pose_dictionary(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """(gloss, pose_sequence) of documents that map glosses to sequences: a row for each gloss, however many a document has."""
    pairs = parts(spark, path, 1, block).where("level = 1").select(_pair(F.col("text"), T.ArrayType(schemas.PERSON)).alias("x"))
    return pairs.where("x IS NOT NULL").select(F.col("x.key").alias("gloss"), F.col("x.value").alias("pose_sequence"))
