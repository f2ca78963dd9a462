"""Size checks, and a join that survives hot keys.

A key may hold a third of all rows, so nothing here gathers a whole key in one task. The driver
only ever receives counts; lists of keys are stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.shared import stored

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000
SALTS = 64


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values in ``df``, summed by one distributed job."""
    def width(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 32
        return F.lit(16)

    total = sum((width(f) for f in df.schema.fields), F.lit(16)).cast("long")
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the measured size of ``df`` allows sending it to every executor."""
    return measured_bytes(df) <= max_bytes


def hot_keys(df: DataFrame, by: Sequence[str], more_than: int = HOT_KEY_ROWS) -> DataFrame | None:
    """All keys with more than ``more_than`` rows as a stored table, or None."""
    found = stored(df.groupBy(*by).count().filter(F.col("count") > more_than).select(*by))
    return None if found.isEmpty() else found


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__{k}" for k in on})
    pairs = [(F.col(f"`{k}`"), F.col(f"`__{k}`")) for k in on]
    same = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return left.join(right, same, how).drop(*[f"__{k}" for k in on])


def _salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """Spread each key of the left side over ``SALTS`` copies of its right rows."""
    # Hash of the row, not rand(): a recomputed task must put its rows where they were before.
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")
    salted = left.withColumn("__salt", salt)
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _join(salted, copies, [*on, "__salt"], how, null_safe).drop("__salt")


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", *,
              null_safe: bool = False, max_bytes: int = BROADCAST_BYTES,
              hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Left or inner equi-join of a large left side that may have hot keys.

    A right side measured to be small is broadcast and the left side never moves. Beyond that,
    rows of ordinary keys meet in a shuffle join, and rows of hot keys take their own paths. Keys hot
    on the right have a match for sure, so an inner join serves them, of which adaptive execution can
    split either side. Of keys hot on the left the few right rows are broadcast if small, else copied
    over salts.
    """
    if is_small(right, max_bytes):
        return _join(left, F.broadcast(right), on, how, null_safe)
    parts = []
    heavy = hot_keys(right, on, hot_rows)
    if heavy is not None:
        if not null_safe:  # a NULL key matches nothing, however many there are
            heavy = heavy.dropna()
        parts.append(_join(_join(left, heavy, on, "left_semi", True), _join(right, heavy, on, "left_semi", True),
                           on, "inner", null_safe))
        left, right = _join(left, heavy, on, "left_anti", True), _join(right, heavy, on, "left_anti", True)
    hot = hot_keys(left, on, hot_rows)
    if hot is None:
        parts.append(_join(left, right, on, how, null_safe))
    else:
        parts.append(_join(_join(left, hot, on, "left_anti", True), right, on, how, null_safe))
        hot_left, hot_right = _join(left, hot, on, "left_semi", True), _join(right, hot, on, "left_semi", True)
        if is_small(hot_right, max_bytes):
            parts.append(_join(hot_left, F.broadcast(hot_right), on, how, null_safe))
        else:
            parts.append(_salted_join(hot_left, hot_right, on, how, null_safe))
    return reduce(DataFrame.unionByName, parts)
