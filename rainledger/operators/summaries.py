"""Comparisons, seasonal summaries, report metrics and insight rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import aggregate_flag, label, not_negative, to_number, to_year
from ..functions.quantiles import GROUP_ROWS, aggregate_columns, aggregate_with_quantiles
from ..schema import AGGREGATE_LABELS, require_columns, require_rows

AREA, COUNT, FLAG = "water_area_ha", "water_body_count", "pond_presence"
# Fixed thresholds of the insight rules.
SLOPE_LIMIT = 0.5
HIGHER, LOWER = 1.2, 0.8
HIGH_QUALITY_PCT, MODERATE_QUALITY_PCT = 90, 70


def _body_count_aggregates(df: DataFrame, count: str) -> list[Column]:
    if count not in df.columns:
        return []
    return [
        F.avg(count).alias(f"{count}_mean"), F.stddev_samp(count).alias(f"{count}_std"),
        F.min(count).alias(f"{count}_min"), F.max(count).alias(f"{count}_max"),
        F.sum(count).alias(f"{count}_sum"),
    ]


def _area_aggregates(area: str) -> list[Column]:
    return [
        F.avg(area).alias(f"{area}_mean"), F.stddev_samp(area).alias(f"{area}_std"),
        F.min(area).alias(f"{area}_min"), F.max(area).alias(f"{area}_max"),
        F.count(area).alias(f"{area}_count"),
    ]


def _variation(area: str) -> Column:
    ratio = F.try_divide(F.col(f"{area}_std"), F.col(f"{area}_mean"))
    return F.coalesce(ratio, F.lit(0.0)).alias(f"{area}_cv")


def intervention_summary(df: DataFrame, flag: str = FLAG, *, area: str = AREA, count: str = COUNT,
                         location: str = "location_id", unmatched: str = "no_intervention",
                         strict: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Statistics with and without intervention, and the increase of the mean in percent.

    A missing flag counts as no intervention, or is left out with ``unmatched='drop'``. The
    increase is NULL unless both groups exist and the mean without intervention is positive.
    """
    require_columns(df, flag, area, location)
    if unmatched not in ("no_intervention", "drop"):
        raise ValueError("unmatched must be 'no_intervention' or 'drop'")
    if strict:
        require_rows(df)
    if unmatched == "drop":
        df = df.filter(F.col(flag).isNotNull())
    keep = [F.col(count)] if count in df.columns else []
    rows = df.filter(not_negative(df, area)).select(
        aggregate_flag(df, flag).alias(flag), to_number(df, area).alias(area), F.col(location), *keep)
    # A single distinct count needs no copy of the rows: partial results are kept per (flag, location).
    stats = aggregate_with_quantiles(
        rows, [flag],
        [*_area_aggregates(area), *_body_count_aggregates(rows, count),
         F.countDistinct(location).alias(f"{location}_nunique")],
        area, {f"{area}_median": 0.5}, group_rows=group_rows)
    # At most two rows from here on.
    both = Window.partitionBy(F.lit(1))
    base = F.max(F.when(F.col(flag) == 0, F.col(f"{area}_mean"))).over(both)
    groups = F.count(F.lit(1)).over(both)
    increase = F.when(F.col(flag) == 0, F.lit(0.0)).otherwise((F.col(f"{area}_mean") - base) / base * 100)
    bodies = [c for c in stats.columns if c.startswith(f"{count}_")]
    return stats.select(
        flag, *[f"{area}_{s}" for s in ("mean", "std", "min", "max", "count", "median")],
        F.col(f"{area}_count").alias(f"{area}_valid_count"), *bodies,
        f"{location}_nunique",
        label(F.col(flag), AGGREGATE_LABELS).alias("intervention_type"),
        _variation(area),
        F.when((groups == 2) & (base > 0), increase).alias("water_area_increase_pct"),
    )


def seasonal_summary(df: DataFrame, level: str = "location_id", *, season: str = "season", area: str = AREA,
                     count: str = COUNT, time: str = "year", location: str = "location_id",
                     strict: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Statistics per place and season with coverage of years and a data-quality label.

    ``level`` is any geographic column. Completeness is distinct years over the span of years: it
    can exceed 1 and is infinite for a single year. When several quality rules apply, gaps win
    over variability, which wins over few rows.
    """
    require_columns(df, level, season, area, time, location)
    if strict:
        require_rows(df)
    extra = [c for c in dict.fromkeys([location, count]) if c in df.columns and c != level]
    rows = (df.filter(F.col(level).isNotNull() & F.col(season).isNotNull() & not_negative(df, area))
            .select(level, season, to_number(df, area).alias(area), to_year(df, time).alias(time), *extra))
    stats = aggregate_with_quantiles(
        rows, [level, season],
        [*_area_aggregates(area), F.min(time).alias(f"{time}_min"), F.max(time).alias(f"{time}_max"),
         F.countDistinct(time).alias(f"{time}_nunique"), F.count(location).alias(f"{location}_count"),
         *_body_count_aggregates(rows, count)],
        area, {f"{area}_median": 0.5}, group_rows=group_rows)
    span = F.col("year_span")
    nunique = F.col(f"{time}_nunique")
    completeness = (F.when(nunique == 0, F.lit(0.0)).when(span == 0, F.lit(float("inf")))
                    .otherwise(nunique / F.nullif(span, F.lit(0))))
    quality = (
        F.when(F.col("data_completeness") < 0.5, "gaps_in_data")
        .when(F.col(f"{area}_cv") > 1.0, "high_variability")
        .when(F.col(f"{area}_count") < 3, "limited_data")
        .otherwise("good")
    )
    return (
        stats.withColumns({
            "year_span": F.col(f"{time}_max") - F.col(f"{time}_min"),
            f"{area}_cv": _variation(area),
        })
        .withColumn("data_completeness", completeness)
        .withColumn("data_quality", quality)
    )


def _per_location(df: DataFrame, location: str, area: str, time: str, flag: str) -> DataFrame:
    """One row of partial results per location (and one for NULL).

    Counting distinct locations, also under a condition, is then a plain count over these rows.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if area in df.columns:
        a = to_number(df, area)
        aggs += [F.sum(a).alias("area"), F.count(a).alias("n_area"), F.max(a).alias("a_max"),
                 F.min(a).alias("a_min")]
    if time in df.columns:
        y = to_year(df, time)
        aggs += [F.min(y).alias("y_min"), F.max(y).alias("y_max")]
    if flag in df.columns:
        f = to_number(df, flag)
        aggs += [F.count_if(f == 1).alias("with"), F.count_if(f == 0).alias("without")]
    place = F.col(location) if location in df.columns else F.lit(None).cast("string")
    return df.groupBy(place.alias("place")).agg(*aggs)


def _long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One global aggregate per metric, as (metric, value) rows of text."""
    one = df.agg(*[c.cast("string").alias(m) for m, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def _common_metrics(df: DataFrame, location: str, time: str) -> tuple[Column, Column]:
    """Distinct locations and range of years, "N/A" without their column."""
    missing = F.max(F.lit("N/A"))
    years = F.concat_ws("-", F.min("y_min").cast("string"), F.max("y_max").cast("string"))
    return F.count("place") if location in df.columns else missing, years if time in df.columns else missing


def summary_metrics(df: DataFrame, *, location: str = "location_id", area: str = AREA, time: str = "year",
                    flag: str = FLAG) -> DataFrame:
    """Report table of (metric, value) texts; a missing flag counts as without intervention."""
    places, years = _common_metrics(df, location, time)
    metrics = {"Total Records": F.coalesce(F.sum("n"), F.lit(0)), "Unique Locations": places, "Year Range": years}
    if area in df.columns:
        metrics["Mean Water Area (ha)"] = _fixed(F.try_divide(F.sum("area"), F.sum("n_area")), 2)
        metrics["Max Water Area (ha)"] = _fixed(F.max("a_max"), 2)
        metrics["Min Water Area (ha)"] = _fixed(F.min("a_min"), 2)
    if flag in df.columns:
        metrics["Records with Pond"] = F.sum("with")
        metrics["Records without Pond"] = F.sum("n") - F.sum("with")
    return _long(_per_location(df, location, area, time, flag), metrics)


def quick_stats(df: DataFrame, *, location: str = "location_id", area: str = AREA, time: str = "year",
                flag: str = FLAG) -> DataFrame:
    """Short (metric, value) texts; a location counts once per flag value, missing flags in neither.

    A metric whose column is absent is "N/A".
    """
    places, years = _common_metrics(df, location, time)
    missing = F.max(F.lit("N/A"))
    metrics = {"Total Locations": places, "Year Range": years,
               "Total Records": F.format_number(F.coalesce(F.sum("n"), F.lit(0)), 0),
               "Avg Water Area": missing, "Max Water Area": missing,
               "Locations with Ponds": missing, "Locations without Ponds": missing}
    if area in df.columns:
        mean = F.try_divide(F.sum("area"), F.sum("n_area"))
        metrics["Avg Water Area"] = F.concat(_fixed(mean, 1), F.lit(" ha"))
        metrics["Max Water Area"] = F.concat(_fixed(F.max("a_max"), 1), F.lit(" ha"))
    if flag in df.columns and location in df.columns:
        known = F.col("place").isNotNull()
        metrics["Locations with Ponds"] = F.count_if(known & (F.col("with") > 0))
        metrics["Locations without Ponds"] = F.count_if(known & (F.col("without") > 0))
    return _long(_per_location(df, location, area, time, flag), metrics)


def key_insights(df: DataFrame, *, area: str = AREA, time: str = "year", season: str = "season",
                 flag: str = FLAG, quality: str = "data_quality") -> DataFrame:
    """Report findings as (insight, level, value); one placeholder row if no rule applies.

    The rows are read once: partial sums per (year, season, flag, good) are re-grouped by each of
    the four dimensions with grouping sets, and the rules read those few rows.
    """
    require_columns(df, area)
    have = {c: c in df.columns for c in (time, season, flag, quality)}
    dims = {
        "d_year": to_number(df, time) if have[time] else F.lit(None).cast("double"),
        "d_season": F.col(season) if have[season] else F.lit(None).cast("string"),
        "d_flag": to_number(df, flag) if have[flag] else F.lit(None).cast("double"),
        "d_good": (F.col(quality).eqNullSafe("good") if have[quality] else F.lit(None).cast("boolean")),
    }
    a = to_number(df, area)
    cube = df.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(
        F.sum(a).alias("s"), F.count(a).alias("m"), F.count(F.lit(1)).alias("n"))
    names = list(dims)
    sides = cube.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.try_divide(F.sum("s"), F.sum("m")).alias("mean"), F.sum("n").alias("n"), F.grouping_id().alias("g"))
    year_row, season_row, flag_row, good_row = (F.col("g") == bits for bits in (7, 11, 13, 14))
    year_row = year_row & F.col("d_year").isNotNull()
    season_row = season_row & F.col("d_season").isNotNull() & F.col("mean").isNotNull()

    def on(rows: Column, what: Column) -> Column:
        return F.when(rows, what)

    top = F.min(on(season_row, F.struct((-F.col("mean")).alias("m"), F.col("d_season").alias("s"))))
    low = F.min(on(season_row, F.struct(F.col("mean").alias("m"), F.col("d_season").alias("s"))))
    facts = sides.agg(
        F.count_if(year_row).alias("years"),
        F.regr_slope(on(year_row, F.col("mean")), on(year_row, F.col("d_year"))).alias("slope"),
        top.alias("top"), low.alias("low"),
        F.max(on(flag_row & (F.col("d_flag") == 1), F.col("mean"))).alias("with"),
        F.max(on(flag_row & (F.col("d_flag") == 0), F.col("mean"))).alias("without"),
        F.sum(on(good_row & F.col("d_good"), F.col("n"))).alias("good"),
        F.sum(on(good_row, F.col("n"))).alias("total"),
    )
    slope, pct = F.col("slope"), F.coalesce("good", F.lit(0)) * 100.0 / F.col("total")
    ratio = F.try_divide(F.col("with"), F.col("without"))

    def row(applies: Column, insight: str, level: Column, value: Column) -> Column:
        return F.when(applies, F.struct(F.lit(insight).alias("insight"), level.alias("level"),
                                        value.cast("double").alias("value")))

    rows = []
    if have[time]:
        level = F.when(slope > SLOPE_LIMIT, "increasing").when(slope < -SLOPE_LIMIT, "declining").otherwise("stable")
        rows.append(row(F.col("years") > 1, "trend", level, slope))
    if have[season]:
        rows.append(row(F.col("top").isNotNull(), "highest_season", F.col("top.s"), -F.col("top.m")))
        rows.append(row(F.col("low").isNotNull(), "lowest_season", F.col("low.s"), F.col("low.m")))
    if have[flag]:
        level = (F.when(F.col("with") > F.col("without") * HIGHER, "higher")
                 .when(F.col("with") < F.col("without") * LOWER, "lower").otherwise("similar"))
        rows.append(row(F.col("total") > 0, "pond_effect", level, ratio))
    if have[quality]:
        level = (F.when(pct > HIGH_QUALITY_PCT, "high").when(pct > MODERATE_QUALITY_PCT, "moderate").otherwise("low"))
        rows.append(row(F.col("total") > 0, "data_quality", level, pct))
    placeholder = row(F.lit(True), "none", F.lit("no_significant_insights"), F.lit(None))
    found = F.filter(F.array(*rows, F.when(F.lit(False), placeholder)), lambda r: r.isNotNull())
    listed = F.when(F.size(found) > 0, found).otherwise(F.array(placeholder))
    return facts.select(F.inline(listed))


def fetch_summary(df: DataFrame, *, location: str = "location_id", area: str = AREA, time: str = "year",
                  season: str = "season") -> DataFrame:
    """Coverage of a cleaned table in one row: locations, years, seasons, range of the measure."""
    require_columns(df, location, area, time, season)
    # One row per place and season is left for the distinct values, however many rows there were.
    parts = df.groupBy(location, season).agg(
        F.min(time).alias("y0"), F.max(time).alias("y1"), F.min(area).alias("a0"), F.max(area).alias("a1"))
    return parts.agg(
        F.countDistinct(location).alias("locations"),
        F.min("y0").alias("first_year"), F.max("y1").alias("last_year"),
        F.array_join(F.array_sort(F.collect_set(season)), ", ").alias("seasons"),
        F.min("a0").alias("min_water_area_ha"), F.max("a1").alias("max_water_area_ha"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column, missing values left out."""
    require_columns(df, column)
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("records"))


def correlation(df: DataFrame, columns: Sequence[str] = (FLAG, AREA)) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are present."""
    require_columns(df, *columns)
    rows = df.select(*[to_number(df, c).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def pearson(a: str, b: str) -> Column:
        # corr() fails on a constant column, whose correlation is undefined: NULL here.
        spread = [F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) for x, y in ((a, b), (b, a))]
        return F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])

    one = rows.agg(*[pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"p{i}").alias("correlation"))
             for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.inline(F.array(*cells)))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, *,
                     group_rows: int = GROUP_ROWS) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles, one row per numeric column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not columns:
        raise ValueError("no numeric columns to describe")
    require_columns(df, *columns)
    rows = df.select(*[to_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    figures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    # One row with all figures of all columns; each column becomes a row of it at the end.
    one = aggregate_columns(
        rows, [], [f(f"v{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in figures.items()],
        {f"v{i}": {f"{name}_{i}": p for name, p in quartiles.items()} for i in range(len(columns))}, group_rows=group_rows)
    described = [F.struct(F.lit(c).alias("column"), F.col(f"count{i}").alias("count"), *[
        F.col(f"{n}{i}").cast("double").alias(n) for n in ("mean", "std", "min")], *[
        F.col(f"{n}_{i}").alias(n) for n in quartiles], F.col(f"max{i}").alias("max")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*described)))
