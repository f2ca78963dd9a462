"""Merging tables that were laid out for it: buckets of the merge keys, so that no row moves again.

Both tables are written once in the same number of buckets, one sorted file per bucket. Any number of later
merges then reads bucket by bucket and shuffles nothing. Rows of hot keys, which would make one bucket as large
as a third of the table, lie beside the buckets in an ordinary table and take the join for hot keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import BROADCAST_BYTES, HOT_KEY_ROWS, hot_keys, skew_join
from ..schema import require_columns
from .merging import AVAILABLE, KEYS

BUCKETS = 64


@dataclass(frozen=True)
class Layout:
    """Where the rows of one table lie: a folder, its schema, the keys and the number of buckets."""

    folder: str
    schema: str
    keys: tuple[str, ...]
    buckets: int

    def ordinary(self, spark: SparkSession) -> DataFrame:
        """The bucketed rows. The catalog entry is new in each session, and only names the files."""
        name = f"buckets_{uuid.uuid4().hex}"
        keys = ", ".join(f"`{k}`" for k in self.keys)
        place = f"{self.folder}/buckets".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return spark.table(name)

    def hot(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/hot")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _write(df: DataFrame, folder: str, keys: Sequence[str], buckets: int, hot: DataFrame | None) -> Layout:
    quoted = [F.col(f"`{k}`") for k in keys]
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys]
    marked = None if hot is None else hot.withColumnsRenamed({k: f"__{k}" for k in keys})
    usual = df if hot is None else df.join(marked, same, "left_anti")
    beside = df.limit(0) if hot is None else df.join(marked, same, "left_semi")
    name = f"buckets_{uuid.uuid4().hex}"
    # The shuffle has the buckets' own hash, so each task writes one file.
    (usual.repartition(buckets, *quoted).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", f"{folder}/buckets").format("parquet").saveAsTable(name))
    beside.write.parquet(f"{folder}/hot")
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return Layout(folder, _ddl(df), tuple(keys), buckets)


def prepare_merge(obs: DataFrame, nrm: DataFrame, folder: str, on: Sequence[str] = KEYS, *, buckets: int = BUCKETS,
                  hot_rows: int = HOT_KEY_ROWS) -> tuple[Layout, Layout]:
    """Write both tables below ``folder``, a new folder that the whole cluster sees.

    ``buckets`` should leave a bucket of either table within a task's memory. A key with more than ``hot_rows`` rows
    in one of the tables, a NULL key too, is hot in both. Both tables are read twice. Keys of the right table get
    the types of the left one, because equal values of different types fall into different buckets.
    """
    if not on:
        raise ValueError("merge keys cannot be empty")
    require_columns(obs, *on)
    require_columns(nrm, *on)
    nrm = nrm.withColumns({k: F.col(f"`{k}`").cast(obs.schema[k].dataType) for k in on})
    found = [h for h in (hot_keys(df, on, hot_rows) for df in (obs, nrm)) if h is not None]
    hot = None
    if found:
        hot = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    folder = folder.rstrip("/")
    return (_write(obs, f"{folder}/left", on, buckets, hot), _write(nrm, f"{folder}/right", on, buckets, hot))


def merge_prepared(spark: SparkSession, obs: Layout, nrm: Layout, *, suffix: str = "_nrm",
                   max_broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The rows of ``merge_interventions``, from two tables written by :func:`prepare_merge`."""
    if (obs.keys, obs.buckets) != (nrm.keys, nrm.buckets):
        raise ValueError("both tables must have the same keys and buckets")
    on = list(obs.keys)
    merged = []
    for left, right, hot in ((obs.ordinary(spark), nrm.ordinary(spark), False), (obs.hot(spark), nrm.hot(spark), True)):
        left, right = left.drop(AVAILABLE), right.drop(AVAILABLE)
        overlap = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
        right = right.withColumnsRenamed(overlap).withColumn(AVAILABLE, F.lit(True))
        if hot:
            if left.isEmpty():
                continue
            merged.append(skew_join(left, right, on, "left", max_bytes=max_broadcast_bytes, hot_rows=hot_rows))
        else:
            renamed = right.withColumnsRenamed({k: f"__{k}" for k in on}).hint("merge")
            same = [F.col(f"`{k}`") == F.col(f"`__{k}`") for k in on]
            merged.append(left.join(renamed, same, "left").drop(*[f"__{k}" for k in on]))
    out = merged[0] if len(merged) == 1 else merged[0].unionByName(merged[1])
    return out.withColumn(AVAILABLE, F.coalesce(F.col(AVAILABLE), F.lit(False)))
