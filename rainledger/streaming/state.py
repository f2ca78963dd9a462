"""Trends and seasonal coverage kept up to date batch by batch.

The state of a group is a row of figures that add up: numbers of rows, sums, sums of squares and products,
extremes, and a bitmap of years. A batch is folded by writing the figures of its own rows to a folder of its
number; the state is the sum of all folders. So a batch costs what its rows cost, whatever came before it, and a
batch that is run again after a failure replaces its own folder and changes nothing.

``compact_state`` sums folders into one. It is written beside them under the number of the last batch in it, and
readers take the latest complete one and the batches after it, so a reader never misses or counts a batch twice
and a job that dies in between leaves the old folders in use.

Rows are counted as they arrive: an exact duplicate counts again. Medians do not add up and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trends import GROUP_BY, trend_quality, valid_rows
from ..schema import Rules
from .landing import stream_observations

#: Years are counted from here in sums, so that squares of them stay exact.
EPOCH = 2000
#: First year of the bitmap, and its words of 64 years; years outside of it are not told apart.
FIRST_YEAR, WORDS = 1900, 4
_SUMMED = ("rows", "n", "no_year", "s_v", "s_vv", "n_t", "s_t", "s_tt", "s_tv")


def _partials() -> list[Column]:
    """The figures of rows with ``__v`` and ``__t`` (value and year, NULL where there is no valid value)."""
    v, t = F.col("__v"), F.col("__t") - EPOCH
    both = F.when(F.col("__t").isNotNull(), v)
    year = (F.col("__t") - FIRST_YEAR).cast("int")
    bit = F.when(year.between(0, 64 * WORDS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), year % 64))
    return [
        F.count(F.lit(1)).alias("rows"), F.count("__v").alias("n"),
        F.count_if(v.isNotNull() & F.col("__t").isNull()).alias("no_year"),
        F.sum(v).alias("s_v"), F.sum(v * v).alias("s_vv"), F.count(both).alias("n_t"),
        F.sum(t).alias("s_t"), F.sum(t * t).alias("s_tt"), F.sum(t * v).alias("s_tv"),
        F.min("__v").alias("low"), F.max("__v").alias("high"), F.min("__t").alias("first"), F.max("__t").alias("last"),
        *[F.bit_or(F.when(F.floor(year / 64) == w, bit)).alias(f"years{w}") for w in range(WORDS)],
    ]


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMMED], F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.bit_or(f"years{w}").alias(f"years{w}") for w in range(WORDS)])


def _folders(spark: SparkSession, state: str) -> tuple[int | None, list[str]]:
    """The last batch of the latest complete sum, if any, and the folders that make up the state."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None, []
    done = [s.getPath().getName() for s in files.listStatus(path)
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = sorted((int(m[2]), m[1], name) for name in done if (m := re.fullmatch(r"(sum|batch)-(\d+)", name)))
    last = max((n for n, kind, _ in found if kind == "sum"), default=None)
    used = [name for n, kind, name in found if (n == last and kind == "sum") or (kind == "batch" and (last is None or n > last))]
    return last, [f"{state}/{name}" for name in used]


def fold_batch(rows: DataFrame, batch: int, state: str, group_by: Sequence[str] = GROUP_BY, *,
               value: str = "water_area_ha", time: str = "year") -> None:
    """Add the rows of a batch to the state in folder ``state``; a batch with the same number is replaced.

    A batch that is part of a sum already is not counted again.
    """
    last, _ = _folders(rows.sparkSession, state)
    if last is not None and batch <= last:
        return
    parts = valid_rows(rows, group_by, value, time).groupBy(*group_by).agg(*_partials())
    parts.write.mode("overwrite").parquet(f"{state}/batch-{batch}")


def read_state(spark: SparkSession, state: str, group_by: Sequence[str] = GROUP_BY) -> DataFrame:
    """The summed figures of all groups."""
    _, folders = _folders(spark, state)
    if not folders:
        raise ValueError(f"no batch has been folded into {state}")
    return _summed(spark.read.parquet(*folders), group_by)


def compact_state(spark: SparkSession, state: str, group_by: Sequence[str] = GROUP_BY) -> None:
    """Sum all folders into one. Those in it are deleted when the next sum is complete, so readers keep theirs."""
    last, folders = _folders(spark, state)
    numbers = [int(f.rsplit("-", 1)[1]) for f in folders]
    if not numbers or max(numbers) == last:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    stale = [s.getPath() for s in files.listStatus(path(state))
             if last is not None and (m := re.fullmatch(r"(sum|batch)-(\d+)", s.getPath().getName()))
             and (int(m[2]) < last or (m[1] == "batch" and int(m[2]) == last))]
    read_state(spark, state, group_by).write.mode("overwrite").parquet(f"{state}/sum-{max(numbers)}")
    for old in stale:
        files.delete(old, True)


def _deviation(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from a number, a sum and a sum of squares."""
    return F.when(n > 1, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)))


def state_trends(figures: DataFrame, group_by: Sequence[str] = GROUP_BY, *, value: str = "water_area_ha") -> DataFrame:
    """The columns of ``water_trends`` but for the median, from summed figures."""
    n, s_v = F.col("n"), F.col("s_v")
    mean, std = s_v / n, _deviation(n, s_v, F.col("s_vv"))
    spread = n * F.col("s_tt") - F.col("s_t") * F.col("s_t")
    slope = F.when(F.col("first") < F.col("last"), F.try_divide(n * F.col("s_tv") - F.col("s_t") * s_v, spread))
    first, last = F.col("first").cast("int"), F.col("last").cast("int")
    return figures.filter((n > 0) & (F.col("no_year") == 0)).select(
        *group_by, mean.alias(f"mean_{value}"), std.alias(f"std_{value}"), F.col("low").alias(f"min_{value}"),
        F.col("high").alias(f"max_{value}"), F.coalesce(slope, F.lit(0.0)).alias("trend_slope_ha_per_year"),
        trend_quality(F.col("first"), F.col("last"), n).alias("trend_quality"), n.alias("data_points"),
        first.alias("start_year"), last.alias("end_year"), (last - first).alias("year_span"),
        F.when(mean > 0, std / mean).otherwise(F.lit(0.0)).alias("coefficient_of_variation"), F.col("rows").alias("total_observations"))


def state_coverage(figures: DataFrame, group_by: Sequence[str] = GROUP_BY) -> DataFrame:
    """Distinct years, their span and the completeness of each group, as in the seasonal summary."""
    years = F.lit(0)
    for w in range(WORDS):
        years = years + F.coalesce(F.bit_count(f"years{w}"), F.lit(0))
    span = (F.col("last") - F.col("first")).cast("int")
    complete = F.when(years == 0, F.lit(0.0)).when(span == 0, F.lit(float("inf"))).otherwise(years / F.nullif(span, F.lit(0)))
    return figures.filter("n > 0").select(
        *group_by, F.col("n").alias("records"), years.cast("long").alias("distinct_years"), span.alias("year_span"),
        complete.alias("data_completeness"))


def keep_trends(spark: SparkSession, landing: str, state: str, progress: str, rules: Rules = Rules(), *,
                max_files: int | None = None) -> StreamingQuery:
    """Fold what is new in the landing directory into the state, then stop.

    The stream gives a batch the same number and files when it runs it again, and the batch replaces itself.
    """
    rows = stream_observations(spark, landing, rules, max_files=max_files)

    def fold(batch: DataFrame, number: int) -> None:
        fold_batch(batch, number, state, (rules.location, rules.season), value=rules.area, time=rules.year)

    return (rows.writeStream.foreachBatch(fold).option("checkpointLocation", progress).trigger(availableNow=True).start())
