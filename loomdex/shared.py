"""The folder that driver and executors share, and frames written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of this machine only where Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomdex-checkpoint-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, without its lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Paths that each application has asked for.
_PATHS: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this application has written under shared_path() so far, indexes too, and counts it; frames read from there are lost.

    Checkpoints of cut() go with their frames where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder, for many later reads of some of its columns."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile Python workers get batches of at most so many rows: they hold two, which else grow with the files up to 10,000 rows or 64 MB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # 0 and less mean no limit
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
