"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


#: Folders of applications that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs on this machine.

    On a cluster executors would write to disks of their own, so there it is an error to name none.
    """
    folder = spark.conf.get(KEY, None)
    if not folder:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{KEY} is unset: name a folder that the driver and the executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="phaseflow-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = _own[app]
    return folder.rstrip("/")


#: Rows that go to Python at a time: whole texts are long, so far fewer than Spark's own default.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 256
#: Bytes that go to Python at a time, for texts that are very long; a row goes whole.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Shuffle files go when the write ends; the table holds all that comes after.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark reads these settings from the session when a job is planned, so writes of one process take turns.
_turn = threading.RLock()


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for one write; as they were afterwards."""
    with _turn:
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The returned frame has no lineage but the files, so a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with _held(spark, {BATCH: str(batch_rows), BATCH_BYTES[0]: BATCH_BYTES[1], CLEANUP: "true"}):
        df.write.option("compression", compression).parquet(path)
    for paths in _made[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`written` that no plan reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


#: Tables that each :func:`alone` under way has made so far.
_made: list[list[str]] = []


def alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The frame of ``make``, written; the tables written on the way to it are deleted."""
    _made.append([])
    try:
        out = written(make(), tag)
    finally:
        paths = _made.pop()
    for path in paths[:-1]:
        _delete(spark, path)
    return out
