"""The tables behind each figure: pivots, series, distributions, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import known_flag, label, not_negative, to_number
from ..functions.quantiles import GROUP_ROWS, aggregate_with_quantiles
from ..functions.skew import skew_join
from ..schema import CHART_LABELS, SEASONS, require_columns
from ..sinks.shared import stored

LOCATION, YEAR, SEASON = "location_id", "year", "season"
AREA, COUNT, FLAG = "water_area_ha", "water_body_count", "pond_presence"
DASHBOARD_SEASONS = ("perennial", "winter", "monsoon")
BINS = 30
#: A list of at most so many names is broadcast.
BROADCAST_ROWS = 10_000
#: Parts of a group from which its first rows are taken in a first step.
SALTS = 64


def _mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.avg(to_number(df, value)).alias(name))


def require_member(df: DataFrame, column: str, value: str, show: int = 10) -> None:
    """Raise ``ValueError`` naming some known values if ``value`` does not occur."""
    require_columns(df, column)
    if df.filter(F.col(column) == value).isEmpty():
        known = [r[0] for r in df.select(column).distinct().limit(show).collect()]
        raise ValueError(f"{value!r} not found in {column}; available: {known}")


def seasonal_pivot(df: DataFrame, *, seasons: Sequence[str] = SEASONS, value: str = AREA) -> DataFrame:
    """Mean of the measure by year, one column per season, 0 where a season has no data."""
    require_columns(df, YEAR, SEASON, value)
    rows = df.filter(F.col(YEAR).isNotNull() & F.col(SEASON).isNotNull())
    return rows.groupBy(YEAR).pivot(SEASON, list(seasons)).agg(F.avg(to_number(df, value))).na.fill(0.0)


def _strict_cell(value: str) -> Column:
    """The only value of a cell; two rows in one cell fail the query."""
    message = F.lit("more than one row for the same year and season")
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("double")).otherwise(F.max(value))


def _strict_pivot(df: DataFrame, keys: Sequence[str], seasons: Sequence[str], value: str) -> DataFrame:
    # One row per cell first, which is where duplicates show; the pivot then only moves cells.
    cells = df.withColumn(value, to_number(df, value)).groupBy(*keys, SEASON).agg(_strict_cell(value).alias(value))
    return cells.groupBy(*keys).pivot(SEASON, list(seasons)).agg(F.max(value)).na.fill(0.0, list(seasons))


def seasonal_pivot_location(df: DataFrame, location: str, *, seasons: Sequence[str] = SEASONS,
                            value: str = AREA, check: bool = False) -> DataFrame:
    """One location's values by year and season, not aggregated: a repeated cell is an error."""
    require_columns(df, LOCATION, YEAR, SEASON, value)
    if check:
        require_member(df, LOCATION, location)
    return _strict_pivot(df.filter(F.col(LOCATION) == location), [YEAR], seasons, value)


def comparison_series(df: DataFrame, flag: str = FLAG, *, value: str = AREA) -> DataFrame:
    """Mean of the measure by year with and without intervention; missing flags are left out."""
    require_columns(df, YEAR, flag, value)
    means = _mean(df.withColumn(flag, known_flag(df, flag)), [YEAR, flag], value, value)
    return means.select(YEAR, label(F.col(flag), CHART_LABELS).alias(flag), value)


def histogram(df: DataFrame, value: str, *, by: str | None = None, bins: int = BINS,
              only: str | None = None) -> DataFrame:
    """Rows per equal-width bin between the overall minimum and maximum, per value of ``by``.

    ``only`` restricts the rows to one value of ``by`` before the range is taken. Bins without
    rows are absent, and infinite values are in none. The range is a scalar subquery, so no row is
    paired with anything.
    """
    require_columns(df, value, *([by] if by else []))
    keys = [by] if by else []
    rows = df.select(*keys, to_number(df, value).alias("v")).filter(F.abs("v") < float("inf"))
    if by:
        rows = rows.filter(F.col(by) == only) if only is not None else rows.filter(F.col(by).isNotNull())
    ends = rows.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("ends")).scalar()
    low, high = ends["low"], ends["high"]
    share = F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0))
    number = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    width = (high - low) / bins
    return counts.select(*keys, "bin", (low + F.col("bin") * width).alias("bin_start"),
                         (low + (F.col("bin") + 1) * width).alias("bin_end"), "records")


#: Steps of round edges are these times a power of ten.
LADDER = (1, 2, 5)


def _round_edges(low: Column, high: Column, whole: Column, bins: int) -> Column:
    """(start, step): the smallest step on the ladder with which at most ``bins`` bins hold [low, high].

    Edges are multiples of the step. Whole numbers have steps of at least 1 and edges half a unit lower,
    so that each lies inside a bin.
    """
    shift = F.when(whole, 0.5).otherwise(0.0)
    decade = F.floor(F.log10(F.greatest((high - low) / bins, F.lit(1e-300))))
    # Rounding may put the logarithm into the decade above; the ladder begins one below.
    steps = F.array(*[F.lit(float(m)) * F.pow(F.lit(10.0), decade + k) for k in range(-1, 3) for m in LADDER])
    steps = F.when(high > low, F.transform(steps, lambda s: F.when(whole, F.greatest(s, F.lit(1.0))).otherwise(s))) \
        .otherwise(F.array(F.lit(1.0)))

    def start(step: Column) -> Column:
        return F.floor(low / step) * step - shift

    fitting = F.filter(steps, lambda step: F.floor((high - start(step)) / step) < bins)
    return F.get(F.transform(fitting, lambda step: F.struct(start(step).alias("start"), step.alias("step"))), 0)


def round_histogram(df: DataFrame, value: str, *, by: str | None = None, bins: int = BINS,
                    only: str | None = None) -> DataFrame:
    """Rows per bin with round edges (steps of 1, 2 or 5 times a power of ten), per value of ``by``.

    At most ``bins`` bins hold all finite values; bins without rows are absent. Whole numbers, whatever the
    column's type, get edges at halves. ``only`` restricts the rows to one value of ``by`` first. A column of
    one value has one bin of width 1.
    """
    require_columns(df, value, *([by] if by else []))
    keys = [by] if by else []
    rows = df.select(*keys, to_number(df, value).cast("double").alias("v")).filter(F.abs("v") < float("inf"))
    if by:
        rows = rows.filter(F.col(by) == only) if only is not None else rows.filter(F.col(by).isNotNull())
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    edges = ends.select(_round_edges(F.col("low"), F.col("high"), F.col("whole"), bins).alias("edges")).scalar()
    start, step = edges["start"], edges["step"]
    counts = rows.groupBy(*keys, F.floor((F.col("v") - start) / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    return counts.select(*keys, "bin", (start + F.col("bin") * step).alias("bin_start"),
                         (start + (F.col("bin") + 1) * step).alias("bin_end"), "records")


def body_count_histogram(df: DataFrame, season: str | None = None, *, bins: int = BINS, round_edges: bool = False) -> DataFrame:
    """Distribution of body counts per season on common bins."""
    return (round_histogram if round_edges else histogram)(df, COUNT, by=SEASON, bins=bins, only=season)


def area_histogram(df: DataFrame, *, bins: int = BINS, round_edges: bool = False) -> DataFrame:
    """Distribution of the measure over all rows."""
    return (round_histogram if round_edges else histogram)(df, AREA, bins=bins)


def heatmap_long(df: DataFrame, metric: str = AREA) -> DataFrame:
    """Mean of a metric per location and year, one row per cell."""
    require_columns(df, LOCATION, YEAR, metric)
    return _mean(df, [LOCATION, YEAR], metric, metric)


def present_years(df: DataFrame) -> list[int]:
    """The years in the table: as many as the pivot has columns."""
    return sorted(r[0] for r in df.select(YEAR).filter(F.col(YEAR).isNotNull()).distinct().collect())


def heatmap_pivot(df: DataFrame, metric: str = AREA, years: Sequence[int] | None = None) -> DataFrame:
    """Mean of a metric, one row per location and one column per year.

    ``years``: the columns wanted; else all years that occur. ``heatmap_long`` has the same cells as rows.
    """
    years = present_years(df) if years is None else list(years)
    require_columns(df, LOCATION, YEAR, metric)
    rows = df.filter(F.col(LOCATION).isNotNull())
    return rows.groupBy(LOCATION).pivot(YEAR, years).agg(F.avg(to_number(df, metric)))


def box_stats(df: DataFrame, by: str = SEASON, value: str = AREA, *, years: tuple[int, int] | None = None,
              group_rows: int = GROUP_ROWS) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outlier counts per group."""
    require_columns(df, by, value)
    if years is not None:
        df = df.filter(F.col(YEAR).between(*years))
    rows = df.filter(F.col(by).isNotNull()).select(by, to_number(df, value).alias("v")).filter(F.col("v").isNotNull())
    quartiles = aggregate_with_quantiles(
        rows, [by], [F.count("v").alias("records")], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75},
        group_rows=group_rows)
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    fences = stored(quartiles.withColumns({"low": F.col("q1") - fence, "high": F.col("q3") + fence}))
    placed = skew_join(rows, fences, [by], "inner")
    inside = F.col("v").between(F.col("low"), F.col("high"))
    # The quartiles ride along as aggregates of a constant, so the groups stay one key wide.
    kept = [F.first(c).alias(c) for c in ("records", "q1", "median", "q3")]
    return placed.groupBy(by).agg(
        *kept,
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def impact_scatter(df: DataFrame, flag: str = FLAG, impact: str = "crop_yield_ton_per_ha", *, n: int | None = None) -> DataFrame:
    """Measure against impact metric, with the intervention status as text.

    All rows, or of each status the ``n`` with the smallest hash: the same points on each run, and a sample
    of the status whatever the number of rows.
    """
    require_columns(df, flag, impact, AREA, LOCATION, YEAR)
    status = "intervention_status"
    points = df.select(LOCATION, YEAR, AREA, impact, label(known_flag(df, flag), CHART_LABELS).alias(status))
    if n is None:
        return points
    # Four decimals of the measures tell rows apart; rows that agree in all of this are interchangeable.
    digits = [F.floor(to_number(points, c) * 10_000).cast("string") for c in (AREA, impact)]
    hashed = points.withColumn("__hash", F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (
        F.col(LOCATION), F.col(YEAR), *digits)])))
    order = ["__hash", LOCATION, YEAR, AREA, impact]
    # The smallest of a status are among the smallest of each of its parts, so no task sorts a whole status.
    part = F.pmod(F.xxhash64("__hash"), F.lit(SALTS))
    few = hashed.withColumn("__at", F.row_number().over(Window.partitionBy(status, part).orderBy(*order))).filter(F.col("__at") <= n)
    few = few.withColumn("__at", F.row_number().over(Window.partitionBy(status).orderBy(*order))).filter(F.col("__at") <= n)
    return few.drop("__hash", "__at")


def impact_grid(df: DataFrame, flag: str = FLAG, impact: str = "crop_yield_ton_per_ha", *, cells: int = 40) -> DataFrame:
    """Rows per status and cell of an even grid over measure and impact: the whole scatter at a fixed size.

    Rows without one of the two are in no cell. Cells without rows are absent.
    """
    points = impact_scatter(df, flag, impact)
    rows = points.select("intervention_status", to_number(points, AREA).alias("x"), to_number(points, impact).alias("y")) \
        .filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    ends = rows.agg(*[F.struct(F.min(c).alias("low"), ((F.max(c) - F.min(c)) / cells).alias("width")).alias(c) for c in ("x", "y")])
    ends = ends.select(F.struct("x", "y").alias("ends")).scalar()

    def cell(c: str) -> Column:
        share = F.coalesce(F.try_divide(F.col(c) - ends[c]["low"], ends[c]["width"]), F.lit(0.0))
        return F.least(F.floor(share), F.lit(cells - 1)).cast("int")

    counts = rows.groupBy("intervention_status", cell("x").alias("x_cell"), cell("y").alias("y_cell")).agg(F.count(F.lit(1)).alias("records"))
    return counts.select("intervention_status", "x_cell", "y_cell", *[
        (ends[c]["low"] + F.col(f"{c}_cell") * ends[c]["width"]).alias(f"{c}_start") for c in ("x", "y")], "records")


def top_locations(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` locations with most rows; equal counts are ordered by name."""
    require_columns(df, LOCATION)
    counts = df.filter(F.col(LOCATION).isNotNull()).groupBy(LOCATION).agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), F.asc(LOCATION)).limit(k)


def dashboard_locations(df: DataFrame, locations: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Rows of the given locations, or of the ``k`` largest."""
    if locations is not None:
        return df.filter(F.col(LOCATION).isin(*locations))
    top = top_locations(df, k).select(F.col(LOCATION).alias("__top"))
    return df.join(F.broadcast(top) if k <= BROADCAST_ROWS else top, F.col(LOCATION) == F.col("__top"), "left_semi")


def dashboard_panel(df: DataFrame, locations: Sequence[str] | None = None, shown: int = 3) -> DataFrame:
    """Rows of the locations that are drawn: the first ``shown`` of those given, or the largest."""
    return dashboard_locations(df, None if locations is None else list(locations)[:shown], shown)


def dashboard_seasonal(df: DataFrame, *, value: str = AREA) -> DataFrame:
    """Values per location, year and season for the stacked panel, which has no summer."""
    require_columns(df, LOCATION, YEAR, SEASON, value)
    return _strict_pivot(df, [LOCATION, YEAR], DASHBOARD_SEASONS, value)


def dashboard_body_count(df: DataFrame) -> DataFrame:
    """Mean body count per location and year."""
    return _mean(df, [LOCATION, YEAR], COUNT, COUNT)


def dashboard_yearly_area(df: DataFrame) -> DataFrame:
    """Mean of the measure per year and location."""
    return _mean(df, [YEAR, LOCATION], AREA, AREA)


def yearly_mean(df: DataFrame) -> DataFrame:
    """Mean of the measure per year."""
    return _mean(df, [YEAR], AREA, AREA)


def bubble_radius(df: DataFrame, location: str | None = None, n: int = 100) -> DataFrame:
    """Radius of the sphere drawn per row: one location's rows, or the first ``n`` in key order."""
    require_columns(df, LOCATION, YEAR, SEASON, AREA)
    area = to_number(df, AREA)
    rows = df.filter(not_negative(df, AREA))
    rows = rows.filter(F.col(LOCATION) == location) if location is not None else head_n(rows, n)
    return rows.select(LOCATION, YEAR, SEASON, AREA, (F.sqrt(area) / 10).alias("radius"))


def head_n(df: DataFrame, n: int, keys: Sequence[str] = (LOCATION, YEAR, SEASON, AREA, COUNT)) -> DataFrame:
    """The first ``n`` rows in key order, missing values last."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys if k in df.columns]).limit(n)
