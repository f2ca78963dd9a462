"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"

#: The folder that the innermost :func:`working_tables` block deletes at its end.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Without that setting a local session uses a folder on its only machine; on a cluster it is an
    error, because an executor's own disk is not seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_FALLBACK
    folder = f"{base.rstrip('/')}/stored-{uuid.uuid4()}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    What reads the result does not compute ``df`` again, also after an executor was lost.
    """
    spark = df.sparkSession
    scratch = _scratch.get()
    path = f"{scratch}/{uuid.uuid4()}" if scratch else f"{shared_folder(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored tables are deleted at its end, and a function that stores what is to stay.

    What the block hands out must be stored by that function, as a plan of its own would still read the
    deleted tables. Blocks may be nested: what an inner one keeps belongs to the outer one.
    """
    folder = shared_folder(spark)
    outer = _scratch.get()

    def keep(df: DataFrame) -> DataFrame:
        within = _scratch.set(outer)
        try:
            return stored(df)
        finally:
            _scratch.reset(within)

    token = _scratch.set(folder)
    try:
        yield keep
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
