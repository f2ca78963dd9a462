"""Writing result tables, and the only place where results are put in order."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json")


def clean_filename(name: str) -> str:
    """Letters, digits, dash and underscore are kept; anything else becomes an underscore."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError("file name must be a non-empty string")
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in name.strip())


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in key order with missing values last: a range-partitioned sort.

    The row hash behind the keys lets the rows of one frequent key be split over several tasks.
    """
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def write_table(df: DataFrame, directory: str, name: str, fmt: str = "csv", *,
                keys: Sequence[str] | None = None, partition_by: Sequence[str] = (),
                allow_empty: bool = False) -> str:
    """Write ``df`` to ``directory/name`` as csv, parquet or json lines, replacing what is there.

    An empty table is an error and is found before anything is replaced. The check runs the query
    up to its first row; pass ``allow_empty`` for plans where that is expensive.

    The rows go to a new folder beside the target, which takes the target's place only when the
    write has succeeded. So ``df`` may read the table that it replaces, and a failed write leaves
    the old table as it was.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; supported: {list(FORMATS)}")
    target = f"{directory.rstrip('/')}/{clean_filename(name)}.{fmt}"
    if not allow_empty and df.isEmpty():
        raise ValueError("cannot export an empty table")
    if keys:
        out = ordered(df, keys)
    else:
        # Few files per directory, and a directory with most of the rows still split by size.
        out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    fresh = f"{target}.new-{uuid.uuid4()}"
    try:
        writer.save(fresh)
    except BaseException:
        _delete(df, fresh)
        raise
    _put_in_place(df, fresh, target)
    return target


def _paths(df: DataFrame, *names: str):
    """The file system of the first name, and all names as its paths."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), *paths


def _delete(df: DataFrame, name: str) -> None:
    files, path = _paths(df, name)
    files.delete(path, True)


def _put_in_place(df: DataFrame, fresh: str, target: str) -> None:
    """Two renames: the old table steps aside and is deleted only when the new one is in place."""
    files, new, place, old = _paths(df, fresh, target, f"{fresh}-old")
    replaces = files.exists(place)
    if replaces and not files.rename(place, old):
        raise OSError(f"cannot replace {target}; the new rows are in {fresh}")
    if not files.rename(new, place):
        if replaces:
            files.rename(old, place)
        raise OSError(f"cannot rename {fresh} to {target}")
    if replaces:
        files.delete(old, True)

