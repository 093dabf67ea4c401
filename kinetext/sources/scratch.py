"""Folders for files that a plan writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEARED: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's folder. It goes when the driver's process ends.

    It lies under the folder that the cluster shares (spark.checkpoint.dir); on a single machine without that setting, under its temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = current.get() if current.isDefined() else "file://" + tempfile.gettempdir()
    path = f"{base}/kinetext-files-{spark.sparkContext.applicationId}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(_delete_at_exit, spark, path)
    return path


def folder(spark: SparkSession) -> str:
    """A new path in this application's folder."""
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's files; results that haven't been computed need them."""
    delete(spark, own_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        delete(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and a lost executor costs a read."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: str) -> None:
    """A small file of its own name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content.encode()))
    out.close()
