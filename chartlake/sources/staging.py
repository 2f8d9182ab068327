"""Tables written on the way, in the folder that driver and executors share: lineage is cut, a lost executor costs its own tasks only."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset and Spark runs in one process, a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the scratch around it or the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def staged(df: DataFrame, what: str = "staged") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors, computes df once.

    The shuffle files behind it go as soon as it is written. Else they would stay until the driver happens to collect its garbage,
    and the disk would hold those of many tables at once, the more the larger the input.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    with _cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Executions started inside remove their shuffle files at their end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are removed at the end, but for what the given function stages."""
    before, kept = len(_STAGED), []

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df, "result")
        kept.append(_STAGED.pop())
        return out

    try:
        yield keep
    finally:
        for entry in _STAGED[before:]:
            _delete(*entry)
        _STAGED[before:] = kept


def _delete(spark: SparkSession, path: str) -> bool:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        return False
    return True


@atexit.register
def _drop_staged() -> None:
    for entry in _STAGED:
        if not _delete(*entry):
            return
