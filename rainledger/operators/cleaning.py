"""Cleaning of observations and intervention records, with reports of what was removed and why."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import (
    computed_once, is_whole, normalize_columns, normalize_flag, strip, to_number, without_nan,
)
from ..schema import INTERVENTION_TYPES, Rules, require_columns, require_rows

DEFAULT = Rules()
#: Counts are BIGINT; this is the largest DOUBLE below its end.
LARGEST_COUNT = float(2**63 - 1024)
OBSERVATION_REASONS = (
    "year_not_whole", "year_out_of_range", "invalid_season", "missing_value",
    "area_out_of_range", "invalid_body_count",
)
INTERVENTION_REASONS = ("year_not_whole", "year_out_of_range", "missing_value")


class _Numbers:
    """The numeric columns of a raw table: text parsed once per row, numbers as they are."""

    def __init__(self, df: DataFrame, *names: str) -> None:
        names = tuple(n for n in names if n in df.columns)
        self.types = {n: df.schema[n].dataType for n in names}
        parsed = {f"__{n}": to_number(df, n) for n in names if not isinstance(self.types[n], T.NumericType)}
        self.columns = df.columns
        self.df = computed_once(df, parsed) if parsed else df

    def whole(self, name: str) -> bool:
        return isinstance(self.types[name], T.IntegralType)

    def plain(self, name: str) -> Column:
        """For comparisons: the column itself where it is numeric, so that they reach the scan."""
        return F.col(name if isinstance(self.types[name], T.NumericType) else f"__{name}")

    def value(self, name: str) -> Column:
        """Integers unchanged, anything else as DOUBLE without NaN."""
        return self.plain(name) if self.whole(name) else without_nan(self.plain(name).cast("double"))

    def year(self, name: str) -> Column:
        number = self.value(name)
        return (number if self.whole(name) else F.when(is_whole(number), number)).try_cast("int")


def _year_reasons(n: _Numbers, rules: Rules) -> list[tuple[Column, str]]:
    number = n.value(rules.year)
    return [
        (number.isNotNull() & ~is_whole(number), "year_not_whole"),
        (~number.between(rules.year_min, rules.year_max), "year_out_of_range"),
    ]


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(failed, reason).otherwise(out)
    return out


def _observation_numbers(df: DataFrame, rules: Rules) -> _Numbers:
    require_columns(df, rules.location, rules.year, rules.season, rules.area)
    return _Numbers(df, rules.year, rules.area, rules.count)


def _observation_columns(n: _Numbers, rules: Rules) -> list[Column]:
    typed = {rules.year: n.year(rules.year), rules.area: n.value(rules.area).cast("double")}
    if rules.count in n.types:
        typed[rules.count] = n.value(rules.count).try_cast("bigint")
    return [typed.get(c, F.col(f"`{c}`")).alias(c) for c in n.columns]


def _observation_reason(n: _Numbers, rules: Rules) -> Column:
    """The first rule a row breaks, NULL if none."""
    area, season = n.value(rules.area), F.col(rules.season)
    checks = [
        *_year_reasons(n, rules),
        (season.isNull() | ~season.isin(*rules.seasons), "invalid_season"),
        (n.value(rules.year).isNull() | area.isNull(), "missing_value"),
        (~area.between(rules.area_min, rules.area_max), "area_out_of_range"),
    ]
    if rules.count in n.types:
        number = n.value(rules.count)
        checks.append((number.isNull() | ~number.between(0, LARGEST_COUNT), "invalid_body_count"))
    return _first_reason(checks)


def _year_in_range(n: _Numbers, rules: Rules) -> Column:
    # NaN needs no test of its own in a range: it is above every bound.
    in_range = n.plain(rules.year).between(rules.year_min, rules.year_max)
    return in_range if n.whole(rules.year) else in_range & is_whole(n.plain(rules.year))


def _valid_observation(n: _Numbers, rules: Rules) -> Column:
    """The same rules as ``_observation_reason`` as one conjunction of simple tests."""
    valid = (_year_in_range(n, rules) & F.col(rules.season).isin(*rules.seasons)
             & n.plain(rules.area).between(rules.area_min, rules.area_max))
    if rules.count in n.types:
        number = n.plain(rules.count)
        valid = valid & (number >= 0)
        if not n.whole(rules.count):
            valid = valid & (number <= LARGEST_COUNT)
    return valid


def _interventions(df: DataFrame, rules: Rules) -> _Numbers:
    df = normalize_columns(df)
    require_columns(df, rules.location, rules.year)
    return _Numbers(df, rules.year, "crop_yield_ton_per_ha")


def _intervention_columns(n: _Numbers, rules: Rules) -> list[Column]:
    typed = {
        rules.year: n.year(rules.year),
        "pond_presence": normalize_flag(F.col("pond_presence")),
        "intervention_type": F.lower(strip(F.col("intervention_type").cast("string"))),
    }
    if "crop_yield_ton_per_ha" in n.types:
        typed["crop_yield_ton_per_ha"] = n.value("crop_yield_ton_per_ha").cast("double")
    return [typed.get(c, F.col(f"`{c}`")).alias(c) for c in n.columns]


def _intervention_reason(n: _Numbers, rules: Rules) -> Column:
    missing = F.col(rules.location).isNull() | n.value(rules.year).isNull()
    return _first_reason([*_year_reasons(n, rules), (missing, "missing_value")])


def typed_observations(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The known columns as numbers, every row kept: the shape charts and reports read uncleaned."""
    n = _observation_numbers(df, rules)
    return n.df.select(*_observation_columns(n, rules))


def valid_observations(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Typed rows that break no rule: cleaning row by row, duplicates left in."""
    n = _observation_numbers(df, rules)
    kept = n.df.filter(_valid_observation(n, rules)).select(*_observation_columns(n, rules))
    if rules.quality not in df.columns:
        kept = kept.withColumn(rules.quality, F.lit(rules.default_quality))
    return kept


def clean_observations(df: DataFrame, rules: Rules = DEFAULT, *, strict: bool = False) -> DataFrame:
    """Typed, valid and distinct observations.

    Rows with a NULL location are kept. Without a body-count column its rule is skipped; without a
    quality column one is added. ``strict`` raises on an empty input, at the price of a job.
    """
    if strict:
        require_rows(df)
    return valid_observations(df, rules).dropDuplicates()


def clean_interventions(df: DataFrame, rules: Rules = DEFAULT, *, strict: bool = False) -> DataFrame:
    """Typed, valid and distinct intervention records with normalised headers and flags."""
    if strict:
        require_rows(df)
    n = _interventions(df, rules)
    valid = _year_in_range(n, rules) & F.col(rules.location).isNotNull()
    return n.df.filter(valid).select(*_intervention_columns(n, rules)).dropDuplicates()


def _report(typed: DataFrame, reasons: Sequence[str], rules: Rules) -> DataFrame:
    """One row of counters from one pass over the rows.

    Rejected rows have their columns blanked, so they collapse to one row per reason before the
    shuffle; valid rows are grouped by all columns, which is the work of removing duplicates.
    """
    columns = [c for c in typed.columns if c != "__reason"]
    keys = [F.when(F.col("__reason").isNull(), F.col(c)).alias(c) for c in columns]
    groups = typed.groupBy("__reason", *keys).agg(F.count(F.lit(1)).alias("__rows"))

    def total(condition: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, what)), F.lit(0)).cast("long")

    valid = F.col("__reason").isNull()
    counts = groups.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("long").alias("original_records"),
        *[total(F.col("__reason") == r, F.col("__rows")).alias(r) for r in reasons],
        total(valid, F.col("__rows") - 1).alias("duplicate"),
        total(valid, F.lit(1)).alias("final_records"),
    )
    removed = F.col("original_records") - F.col("final_records")
    rate = F.coalesce(F.try_divide(removed * 100.0, F.col("original_records")), F.lit(0.0))
    return counts.withColumns({
        "records_removed": removed,
        "removal_rate_pct": rate,
        "high_removal": rate > rules.high_removal_pct,
    })


def cleaning_report(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """How many observations each rule removes. A row counts under the first rule it breaks."""
    n = _observation_numbers(df, rules)
    typed = n.df.select(*_observation_columns(n, rules), _observation_reason(n, rules).alias("__reason"))
    return _report(typed, OBSERVATION_REASONS, rules)


def interventions_report(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """How many intervention records each rule removes."""
    n = _interventions(df, rules)
    typed = n.df.select(*_intervention_columns(n, rules), _intervention_reason(n, rules).alias("__reason"))
    return _report(typed, INTERVENTION_REASONS, rules)


def rejected_observations(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The raw rows that break a rule, with the reason, for quarantine."""
    n = _observation_numbers(df, rules)
    broken = n.df.filter(~F.coalesce(_valid_observation(n, rules), F.lit(False)))
    return broken.select(*[F.col(f"`{c}`") for c in n.columns], _observation_reason(n, rules).alias("reason"))


def unknown_categories(df: DataFrame, column: str = "intervention_type",
                       allowed: Sequence[str] = (*INTERVENTION_TYPES, "none", "")) -> DataFrame:
    """Values outside the known set with their row counts; the rows themselves are not removed."""
    require_columns(df, column)
    return df.filter(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("records"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row of every set of identical rows; NULL equals NULL."""
    return df.dropDuplicates()


def concat_locations(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; a column absent from one input is NULL there."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
