"""What the library needs to know about the running session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without that
    setting gets a temporary folder, because there all tasks share one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="kilnflow-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Its lineage ends there: a lost executor costs a read, not the work before it. What
    follows sees a columnar table of known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark itself sees them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    return [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    files, where = _folder(spark, path)
    files.delete(where, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`staged` whose tables are removed at the end; they are read in ``spark``."""
    root = scratch_path(spark, "work")

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        remove(spark, root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
