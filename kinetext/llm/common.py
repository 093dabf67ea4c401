"""What the operators of this subpackage share: scratch tables, size-checked
joins and Arrow batches without copies."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A join side up to this many bytes (as Spark's plan statistics or our own count say) is broadcast.
BROADCAST_LIMIT = 32 << 20
#: Bytes of text that a Python step works on at a time.
BLOCK_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
NO_ID = (1 << 63) - 1


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A folder of our own only where none is set and all runs on this machine, as in tests; elsewhere a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="kinetext-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/kinetext-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; results that haven't been computed need them."""
    delete(spark, own_folder(spark))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_MADE: list[list[str]] = []


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The folders of the tables that are written inside, in order."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and a lost executor costs a read."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """Narrow rows dealt to as many splits as the cluster has cores: their table has no more files, however many splits the texts had that they come from."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def checkpoint(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def sized_broadcast(df: DataFrame, bytes_of: Column, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, by ``bytes_of`` plus 48 bytes each, stay within ``limit`` (BROADCAST_LIMIT); else unchanged, so that Spark shuffles."""
    total = df.agg(F.sum(bytes_of.cast("long") + F.lit(48))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_LIMIT if limit is None else limit) else df


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_text(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column as a string, whatever it was."""
    kind = df.schema[name].dataType
    return df if isinstance(kind, T.StringType) else df.withColumn(name, F.col(f"`{name}`").cast("string"))


def texts(column: pa.Array) -> list[bytes]:
    """A string column's bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_array(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary()).view(pa.string())


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], reads: str, drop: Iterable[str] = (), block: int = BLOCK_BYTES) -> DataFrame:
    """``df`` without the columns in ``drop`` and with what ``fn`` computes from each slice of a batch.

    Slices hold about ``block`` bytes of column ``reads``. New columns replace
    columns of the same name.
    """
    new = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, reads, block):
                out = fn(part)
                columns = [part.column(f.name) for f in kept] + [out[f.name] for f in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and all of an executor's count together."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, name: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of a text column (single rows may be larger)."""
    ends = offsets(batch.column(name))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and where each row starts and ends in it; null rows are empty."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
