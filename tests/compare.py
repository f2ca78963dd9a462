"""Runs named queries on Spark and their SQL on DuckDB, and compares rows, names and types."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, directory: str, name: str) -> str | None:
    """None if both engines agree, else what differs."""
    df = entry.queries()[name](spark, directory)
    rel = con.sql(entry.oracle_sql()[name])
    ours = {f: KINDS.get(t, t) for f, t in df.dtypes}
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    if ours != theirs:
        return f"columns differ: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    cols = sorted(ours)
    a = Counter(tuple(r[c] for c in cols) for r in df.collect())
    b = Counter(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    if a == b:
        return None
    only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"{sum(a.values())} and {sum(b.values())} rows; {cols}; only Spark {only_a}; only SQL {only_b}"
