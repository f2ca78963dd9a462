"""Exact distinct counts as mergeable bitmaps.

Each value gets a number once. A group then holds one bitmap per 32,768 numbers instead of one row per value,
and bitmaps of narrow groups add up to those of wider ones: a distinct count per season, per year and of all
rows comes from the bitmaps per (season, year), without a second reading of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .skew import BROADCAST_BYTES, skew_join

BUCKET, BITMAP, NUMBER = "bucket", "bitmap", "number"


def value_numbers(df: DataFrame, value: str) -> DataFrame:
    """(value, number) of each value that occurs but NULL, as a stored table; numbers are close together.

    The table is written once: computed again it could give other numbers.
    """
    distinct = df.select(F.col(f"`{value}`").alias(value)).dropna().distinct()
    return stored(distinct.withColumn(NUMBER, F.monotonically_increasing_id()))


def distinct_bitmaps(df: DataFrame, by: Sequence[str], value: str, *, numbers: DataFrame | None = None,
                     max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(by, bucket, bitmap) of the values of each group; NULL values have no bit, NULL keys are a group.

    ``numbers`` is the table that several sets of bitmaps share which are to be combined. A table beyond the
    broadcast limit meets the rows in a join that splits frequent values. Bits are set before the shuffle.
    """
    numbers = value_numbers(df, value) if numbers is None else numbers
    rows = df.select(*[F.col(f"`{k}`").alias(f"__by{i}") for i, k in enumerate(by)], F.col(f"`{value}`").alias("__value"))
    known = skew_join(rows, numbers.select(F.col(f"`{value}`").alias("__value"), F.col(NUMBER).alias("__number")),
                      ["__value"], "inner", max_bytes=max_broadcast_bytes)
    keys = [F.col(f"__by{i}").alias(k) for i, k in enumerate(by)]
    return known.groupBy(*keys, F.bitmap_bucket_number("__number").alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__number")).alias(BITMAP))


def merged_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of wider groups, or of several tables with the same numbers united by rows."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """Distinct values per group of bitmaps that are unique by (by, bucket)."""
    return bitmaps.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(BITMAP)), F.lit(0)).alias(name))


def distinct_rollup(df: DataFrame, by: Sequence[str], value: str, name: str = "n_distinct", *,
                    max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Distinct values for each beginning of ``by``, down to all rows: keys, level (number of keys), count.

    Keys beyond the level are NULL. Rows are read once for the numbers and once for the finest bitmaps. A group
    whose values are all NULL has no row; of a table without any value the single row of level 0 is left.
    """
    finest = stored(distinct_bitmaps(df, by, value, max_broadcast_bytes=max_broadcast_bytes))
    parts, bitmaps = [], finest
    for level in range(len(by), -1, -1):
        keys = list(by[:level])
        bitmaps = bitmaps if level == len(by) else merged_bitmaps(bitmaps, keys)
        parts.append(distinct_counts(bitmaps, keys, name).select(
            *[F.col(f"`{k}`") if k in keys else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in by],
            F.lit(level).alias("level"), name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
