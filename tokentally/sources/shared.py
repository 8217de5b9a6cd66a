"""Folders and tables that all executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Whether a query's shuffle files go when it has ended, instead of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folders made within `short_lived_tables`.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder, removed when the application ends, or at the
    end of `short_lived_tables`.

    Only a local session, whose executors share the driver's disk, may do without that setting.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    if (held := _FOLDERS.get()) is not None:
        held.append(folder)
    return f"{folder}/data"


@contextmanager
def short_lived_tables(spark: SparkSession) -> Iterator[None]:
    """Folders made within the block are removed at its end; what it returns must be `written` as kept."""
    held: list[str] = []
    token = _FOLDERS.set(held)
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        for folder in held:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, a query's shuffle files are removed as soon as it has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """The frame as a table in a shared folder: computed once, and safe from lost executors.

    Nothing that led to it is needed any more, so its shuffles do not stay on the disks. A kept table
    outlives `short_lived_tables`.
    """
    token = _FOLDERS.set(None) if kept else None
    path = shared_folder(df.sparkSession, name)
    if token:
        _FOLDERS.reset(token)
    with _short_lived_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
