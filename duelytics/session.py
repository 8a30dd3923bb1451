"""Session defaults for local runs; a cluster brings its own configuration."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_open: ContextVar[list[str] | None] = ContextVar("stored_paths", default=None)


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("duelytics")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="duelytics-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared checkpoint folder that goes when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows written once as Parquet and read back.  Unlike a checkpoint the files tell Spark
    their size, so that it can choose how to join them."""
    path = new_folder(df.sparkSession, name)
    if (paths := _open.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes inside go at the end, also after an error.  For jobs that have written their
    results by then; a table that is returned unread must not be stored inside."""
    before = _open.set([])
    try:
        yield
    finally:
        paths = _open.get()
        _open.reset(before)
        for path in paths:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
