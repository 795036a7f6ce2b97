"""Intermediate results that survive the loss of an executor, and file operations on any file system.

A result used by several later jobs is written as Parquet to the shared folder which the cluster
names in ``spark.checkpoint.dir`` and read back, which also cuts its lineage. Only a session on one machine may do
without that setting; it gets a folder of its own. Elsewhere a missing setting raises, as each executor would write
to a disk of its own. Intermediates that a later one replaces are released at once, the others by ``clear`` or when
the driver process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="curaspark-")
    return _OWN[key]


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on the file system that the path names, else the default one."""
    system, target = _place(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; a missing one is fine."""
    system, target = _place(spark, path)
    system.delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename within a file system; raises if it can't."""
    system, target = _place(spark, path)
    if not system.rename(target, _place(spark, to)[1]):
        raise OSError(f"can't move {path} to {to}")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed by ``clear`` or when the driver process ends."""
    path = f"{shared_dir(spark)}/curaspark/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return it read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*stored: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more; other tables are left alone."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path is not None and path in _WRITTEN:
            remove(_WRITTEN.pop(path), path)


def clear() -> None:
    """Delete all intermediates; results that are still lazy can't be computed afterwards."""
    for path, spark in list(_WRITTEN.items()):
        _WRITTEN.pop(path, None)
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the context may be gone already  # noqa: BLE001
            pass


atexit.register(clear)
