"""Linear trends per group, their summaries, and changes from year to year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import known_flag, to_number
from ..functions.quantiles import GROUP_ROWS, aggregate_with_quantiles
from ..schema import require_columns, require_rows

GROUP_BY = ("location_id", "season")
SUCCESS = ("good", "minimal_data")


def _present(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def valid_rows(df: DataFrame, group_by: Sequence[str], value: str, time: str) -> DataFrame:
    """Keys, and value and year where the value is a number >= 0 (both NULL elsewhere)."""
    if not group_by:
        raise ValueError("group_by cannot be empty")
    require_columns(df, *group_by, value, time)
    valid = to_number(df, value) >= 0
    return df.filter(_present(group_by)).select(
        *group_by,
        F.when(valid, to_number(df, value)).alias("__v"),
        F.when(valid, to_number(df, time)).alias("__t"),
    )


def _slope_aggregates() -> list[Column]:
    # A valid row without a year disqualifies its group, so those rows are counted apart.
    return [
        F.count("__v").alias("data_points"),
        F.count_if(F.col("__v").isNotNull() & F.col("__t").isNull()).alias("__no_year"),
        F.min("__t").alias("__first"),
        F.max("__t").alias("__last"),
        F.regr_slope("__v", "__t").alias("__slope"),
    ]


def _usable() -> Column:
    return (F.col("data_points") > 0) & (F.col("__no_year") == 0)


def trend_quality(first: Column, last: Column, n: Column) -> Column:
    """How far a slope can be trusted, from the first and the last year and the number of values."""
    return (F.when((first < last) & (n >= 3), "good").when((first < last) & (n == 2), "minimal_data")
            .otherwise("insufficient_data"))


def _quality() -> Column:
    return trend_quality(F.col("__first"), F.col("__last"), F.col("data_points"))


def _slope() -> Column:
    return F.when(F.col("__first") < F.col("__last"), F.coalesce("__slope", F.lit(0.0))).otherwise(F.lit(0.0))


def water_trends(df: DataFrame, group_by: Sequence[str] = GROUP_BY, *, value: str = "water_area_ha",
                 time: str = "year", strict: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Level, spread and least-squares slope per year of ``value`` for every group.

    Groups with a NULL key, without a value >= 0, or with a valid value lacking its year are left
    out. The slope is 0 with quality ``insufficient_data`` unless the values cover two years.
    """
    if strict:
        require_rows(df)
    rows = valid_rows(df, group_by, value, time)
    stats = aggregate_with_quantiles(
        rows, group_by,
        [
            F.avg("__v").alias("__mean"), F.stddev_samp("__v").alias("__std"),
            F.min("__v").alias("__min"), F.max("__v").alias("__max"),
            F.count(F.lit(1)).alias("total_observations"), *_slope_aggregates(),
        ],
        "__v", {"__median": 0.5}, group_rows=group_rows,
    ).filter(_usable())
    first, last = F.col("__first").cast("int"), F.col("__last").cast("int")
    mean, std = F.col("__mean"), F.col("__std")
    return stats.select(
        *group_by,
        mean.alias(f"mean_{value}"), std.alias(f"std_{value}"),
        F.col("__min").alias(f"min_{value}"), F.col("__max").alias(f"max_{value}"),
        F.col("__median").alias(f"median_{value}"),
        _slope().alias("trend_slope_ha_per_year"), _quality().alias("trend_quality"),
        "data_points", first.alias("start_year"), last.alias("end_year"),
        (last - first).alias("year_span"),
        F.when(mean > 0, std / mean).otherwise(F.lit(0.0)).alias("coefficient_of_variation"),
        "total_observations",
    )


def trend_slopes(df: DataFrame, group_by: Sequence[str] = GROUP_BY, *, value: str = "water_area_ha",
                 time: str = "year") -> DataFrame:
    """Slope and quality only: mergeable aggregates, one shuffle of partial sums."""
    stats = valid_rows(df, group_by, value, time).groupBy(*group_by).agg(*_slope_aggregates())
    return stats.filter(_usable()).select(
        *group_by, _slope().alias("trend_slope_ha_per_year"), _quality().alias("trend_quality"), "data_points")


def trend_summary(df: DataFrame, group_by: Sequence[str] = GROUP_BY, *, value: str = "water_area_ha",
                  time: str = "year") -> DataFrame:
    """Groups seen, groups with a usable slope, their share in percent, and the mean slope."""
    stats = valid_rows(df, group_by, value, time).groupBy(*group_by).agg(*_slope_aggregates())
    done = _usable() & _quality().isin(*SUCCESS)
    total, ok = F.count(F.lit(1)), F.count_if(done)
    return stats.agg(
        total.alias("groups_processed"), ok.alias("successful_groups"),
        F.try_divide(ok * 100.0, total).alias("success_rate_pct"),
        F.avg(F.when(_usable(), _slope())).alias("mean_slope_ha_per_year"),
    )


def trend_by_intervention(df: DataFrame, flag: str = "pond_presence", group_by: Sequence[str] = GROUP_BY, *,
                          value: str = "water_area_ha", time: str = "year") -> DataFrame:
    """Mean slope of the groups with and without intervention, from one pass over the rows."""
    require_columns(df, flag)
    flagged = df.withColumn(flag, known_flag(df, flag))
    slopes = trend_slopes(flagged.filter(F.col(flag).isin(0, 1)), [flag, *group_by], value=value, time=time)
    return slopes.groupBy(flag).agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("trend_slope_ha_per_year").alias("mean_slope_ha_per_year"),
    )


def yoy_change(df: DataFrame, location: str = "location_id", *, value: str = "water_area_ha",
               time: str = "year") -> DataFrame:
    """Yearly mean per location with the change from the previous year that has data."""
    require_columns(df, location, value, time)
    yearly = (df.filter(F.col(location).isNotNull() & F.col(time).isNotNull())
              .groupBy(location, time).agg(F.avg(to_number(df, value)).alias(f"mean_{value}")))
    mean = F.col(f"mean_{value}")
    before = F.lag(mean).over(Window.partitionBy(location).orderBy(time))
    return yearly.select(
        location, time, mean,
        (mean - before).alias("change_ha"),
        F.when(before > 0, (mean - before) / before * 100).alias("change_pct"),
    )


def location_summaries(df: DataFrame, location: str = "location_id", *, value: str = "water_area_ha",
                       count: str = "water_body_count", time: str = "year") -> DataFrame:
    """Totals per location: rows, years covered, level and range of the measure, mean body count."""
    require_columns(df, location, value, time)
    v = to_number(df, value)
    aggs = [
        F.count(F.lit(1)).alias("records"), F.min(time).alias("first_year"), F.max(time).alias("last_year"),
        F.avg(v).alias(f"{value}_mean"), F.min(v).alias(f"{value}_min"), F.max(v).alias(f"{value}_max"),
    ]
    if count in df.columns:
        aggs.append(F.avg(count).alias(f"{count}_mean"))
    return df.filter(F.col(location).isNotNull()).groupBy(location).agg(*aggs)


def aggregated_metrics(summaries: DataFrame, *, value: str = "water_area_ha",
                       location: str = "location_id") -> DataFrame:
    """The same measures over all locations, from the rows of ``location_summaries``."""
    records = F.sum("records")
    return summaries.agg(
        F.count(location).alias("locations"), records.alias("records"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
        F.avg(f"{value}_mean").alias(f"{value}_mean_of_locations"),
        F.min(f"{value}_min").alias(f"{value}_min"), F.max(f"{value}_max").alias(f"{value}_max"),
    )
