"""Tables that are replaced without a rename, for stores where a rename is a copy.

A table is a folder ``root`` with one folder of rows per version and one small pointer file per version in
``root/_versions``. A version exists once its pointer is complete. Pointers are numbered, written once and never
changed, so a reader sees the old version or the new one whatever happens to the writer:

* killed while it writes rows: the folder has no pointer and is not seen;
* killed while it writes the pointer: the pointer lacks its last line and is not seen;
* two writers at once: one of them finds the number taken and takes the next one.

Old versions are removed by a call of their own, so that readers at work can finish.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"
#: Last line of a complete pointer.
END = "complete"
DIGITS = 20


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, folder: str) -> list:
    files, path = _files(spark, folder)
    return list(files.listStatus(path)) if files.exists(path) else []


def _pointer(spark: SparkSession, root: str, number: int) -> str:
    return f"{root}/{POINTERS}/{number:0{DIGITS}d}"


def _folder_of(spark: SparkSession, root: str, number: int) -> str | None:
    """The folder that a pointer names; None if the pointer is missing or incomplete."""
    files, path = _files(spark, _pointer(spark, root, number))
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return lines[0] if lines[1:2] == [END] else None


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all pointers, also incomplete ones, in ascending order."""
    names = [s.getPath().getName() for s in _listed(spark, f"{root}/{POINTERS}")]
    return sorted(int(n) for n in names if n.isdigit() and len(n) == DIGITS)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that can be read, in ascending order."""
    root = root.rstrip("/")
    return [n for n in _numbers(spark, root) if _folder_of(spark, root, n)]


def _publish(spark: SparkSession, root: str, folder: str) -> int:
    """Point to the folder by the first number that is free, after all numbers there are."""
    number = max(_numbers(spark, root), default=0) + 1
    while not _written(spark, _pointer(spark, root, number), bytearray(f"{folder}\n{END}\n", "utf-8")):
        number += 1
    return number


def _written(spark: SparkSession, name: str, content: bytearray) -> bool:
    """Write a new file; False if there is one of this name, also if another writer makes it at the same time."""
    files, path = _files(spark, name)
    if path.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
        # Hadoop's local files are looked for first and made then; the operating system does both at once.
        files.mkdirs(path.getParent())
        try:
            with open(path.toUri().getPath(), "xb") as out:
                out.write(content)
        except FileExistsError:
            return False
        return True
    try:
        stream = files.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    stream.write(content)
    stream.close()
    return True


def write_version(df: DataFrame, root: str, fmt: str = "parquet", *, partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the newest version of the table and return its number. ``df`` may read older versions."""
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"rows-{uuid.uuid4()}"
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{root}/{folder}")
    return _publish(spark, root, folder)


def read_version(spark: SparkSession, root: str, number: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A version of the table, the newest one by default. The frame stays with it when another one follows."""
    root = root.rstrip("/")
    for n in [number] if number is not None else reversed(_numbers(spark, root)):
        folder = _folder_of(spark, root, n)
        if folder:
            return spark.read.format(fmt).load(f"{root}/{folder}")
    raise ValueError(f"no version {'' if number is None else f'{number} '}in {root}")


def remove_old_versions(spark: SparkSession, root: str, keep: int = 2, *, abandoned_hours: float = 24.0) -> list[int]:
    """Delete all but the newest ``keep`` versions, and rows without a pointer that are older than some hours.

    A pointer goes before its rows, so a removal that is interrupted leaves no pointer to missing rows. Younger
    folders without a pointer may belong to a writer at work. Returns the removed numbers.
    """
    if keep < 1:
        raise ValueError("at least one version must stay")
    root = root.rstrip("/")
    # The listing comes first: what is published meanwhile is not in it.
    found = [(s.getPath().getName(), s.getModificationTime()) for s in _listed(spark, root)]
    complete = versions(spark, root)
    gone = complete[:-keep]
    folders = {n: _folder_of(spark, root, n) for n in complete}
    for n in gone:
        files, path = _files(spark, _pointer(spark, root, n))
        files.delete(path, False)
        files, path = _files(spark, f"{root}/{folders[n]}")
        files.delete(path, True)
    oldest = (time.time() - abandoned_hours * 3600) * 1000
    for name, at in found:
        if name.startswith("rows-") and name not in folders.values() and at < oldest:
            files, path = _files(spark, f"{root}/{name}")
            files.delete(path, True)
    return gone
