"""Frame rates and durations of recordings, from the headers of their containers (ISO base media: MP4, MOV).

A file is a row of boxes, and boxes hold boxes. Only box headers and the few
small boxes that say how long a track is are read, by byte ranges; pictures
never are, wherever they stand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nested import Read, opened
from .srt import ENTRY

#: Boxes that hold boxes on the way to a track's times.
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: Entries of a table of times that are read at a time.
ENTRIES = 1 << 16


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the content) of the boxes between two places; a broken size ends them."""
    while at + 8 <= end:
        head = read(at, 16)
        if len(head) < 8:
            return
        size, kind = struct.unpack(">I4s", head[:8])
        start = at + 8
        if size == 1:
            if len(head) < 16:
                return
            size, start = struct.unpack(">Q", head[8:])[0], at + 16
        elif size == 0:  # to the end
            size = end - at
        if size < start - at:
            return
        yield kind, start, min(at + size, end)
        at += size


def track_times(read: Read, size: int) -> tuple[float, float] | None:
    """(frames a second, seconds) of the first video track; None if there is none that says so."""
    for kind, a, b in boxes(read, 0, size):
        if kind == b"moov":
            for own, c, d in boxes(read, a, b):
                if own == b"trak" and (found := _track(read, c, d)):
                    return found
    return None


def _track(read: Read, start: int, end: int) -> tuple[float, float] | None:
    scale = length = frames = 0
    video = False
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        for kind, c, d in boxes(read, a, b):
            if kind in HOLDERS:
                todo.append((c, d))
            elif kind == b"hdlr":
                video = read(c + 8, 4) == b"vide"
            elif kind == b"mdhd":
                wide = read(c, 1) == b"\x01"  # times of 64 bits
                data = read(c + (20 if wide else 12), 12 if wide else 8)
                if len(data) == (12 if wide else 8):
                    scale, length = struct.unpack(">IQ" if wide else ">II", data)
            elif kind == b"stts":
                n = int.from_bytes(read(c + 4, 4), "big")
                for i in range(0, min(n, (d - c - 8) // 8), ENTRIES):
                    data = read(c + 8 + 8 * i, 8 * min(ENTRIES, n - i))
                    frames += sum(count for count, _ in struct.iter_unpack(">II", data[: len(data) // 8 * 8]))
    return (frames * scale / length, length / scale) if video and scale and length and frames else None


def frame_rates(spark: SparkSession, path: str) -> DataFrame:
    """(entry, path, fps, seconds) of recordings; null where a file does not say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [track_times(opened(p), n) or (None, None) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            fps, seconds = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(fps, pa.float64()), pa.array(seconds, pa.float64())], names=["path", "fps", "seconds"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, fps double, seconds double").select(F.regexp_extract("path", ENTRY, 1).alias("entry"), "path", "fps", "seconds")


def with_rates(blocks: DataFrame, rates: DataFrame, default: float = 50.0) -> DataFrame:
    """``blocks`` with ``fps`` of their entry's recording (of several the first by path), or the default."""
    first = rates.where("fps IS NOT NULL").groupBy("entry").agg(F.min_by("fps", "path").alias("fps"))
    return blocks.drop("fps").join(first, "entry", "left").withColumn("fps", F.coalesce("fps", F.lit(default)))


def header(scale: int, length: int, counts: list[tuple[int, int]], kind: bytes = b"vide", wide: bool = False) -> bytes:
    """The boxes that say a track's times and nothing else: what a recording without pictures has."""
    box = lambda name, data: struct.pack(">I4s", 8 + len(data), name) + data
    mdhd = b"\1\0\0\0" + struct.pack(">QQIQI", 0, 0, scale, length, 0) if wide else b"\0" * 4 + struct.pack(">IIIII", 0, 0, scale, length, 0)
    stts = b"\0" * 4 + struct.pack(">I", len(counts)) + b"".join(struct.pack(">II", *c) for c in counts)
    hdlr = b"\0" * 8 + kind + b"\0" * 13
    return box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", mdhd) + box(b"hdlr", hdlr) + box(b"minf", box(b"stbl", box(b"stts", stts))))))


def write_headers(rows: DataFrame, folder: str) -> DataFrame:
    """A file ``folder``/<entry>/video.mp4 for each row (entry, scale, length, frames), written by the tasks; returns their paths."""
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for entry, scale, length, frames in zip(*(batch.column(c).to_pylist() for c in ("entry", "scale", "length", "frames")), strict=True):
                fs, name = pafs.FileSystem.from_uri(f"{base}/{entry}/video.mp4")
                fs.create_dir(name.rpartition("/")[0])
                with fs.open_output_stream(name) as out:  # the same bytes whenever a task is run again
                    out.write(header(scale, length, [(frames, length // max(1, frames))]))
                paths.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return rows.mapInArrow(run, "path string")
