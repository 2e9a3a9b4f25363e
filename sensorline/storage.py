"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []
#: Folder of the run that is under way in this thread.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only in local mode, where executors share the driver's disk, is there one of our own instead; elsewhere its absence is
    an error, since executors would write where nobody reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="sensorline-"))
        atexit.register(_remove_own_root)
    return f"file://{_OWN_ROOT[0]}"


def _remove_own_root() -> None:
    import shutil

    for root in _OWN_ROOT:
        shutil.rmtree(root, ignore_errors=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name below the folder of the current run, or below the shared folder outside of runs."""
    return f"{_RUN.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """Write a frame once as Parquet and read it back."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    Later jobs read files that outlive executors instead of computing the lineage again.
    """
    return written(frame, fresh_path(frame.sparkSession, label))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of what is done inside, deleted at the end.

    Frames that come from them are lazy: write or collect results before the end. Runs of other threads have other folders.
    """
    path = fresh_path(spark, "run")
    mark = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(mark)
        remove(spark, path)
