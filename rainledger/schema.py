"""Column names, fixed value sets and validation limits of the panel data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the data model.
SEASONS = ("perennial", "winter", "monsoon", "summer")
INTERVENTION_TYPES = ("pond", "check_dam", "contour_bund", "other")
UNIT_TYPES = ("village", "micro-watershed", "tehsil", "watershed", "block", "district")
FLAG_TRUE = ("yes", "y", "true", "t", "1", "present")
FLAG_FALSE = ("no", "n", "false", "f", "0", "absent", "none")
NULL_TOKENS = (
    "", "NA", "N/A", "null", "None", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN",
    "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NULL", "NaN", "n/a", "nan",
)
AGGREGATE_LABELS = {0: "No Intervention", 1: "With Intervention"}
CHART_LABELS = {0: "Without Intervention", 1: "With Intervention"}

OBSERVATIONS = T.StructType([
    T.StructField("location_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("season", T.StringType()),
    T.StructField("water_area_ha", T.DoubleType()),
    T.StructField("water_body_count", T.LongType()),
    T.StructField("data_quality", T.StringType()),
])

INTERVENTIONS = T.StructType([
    T.StructField("location_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("pond_presence", T.IntegerType()),
    T.StructField("intervention_type", T.StringType()),
    T.StructField("crop_yield_ton_per_ha", T.DoubleType()),
    T.StructField("drought_sensitivity", T.StringType()),
])


@dataclass(frozen=True)
class Rules:
    """Limits and column names used when observations and interventions are cleaned."""

    location: str = "location_id"
    year: str = "year"
    season: str = "season"
    area: str = "water_area_ha"
    count: str = "water_body_count"
    quality: str = "data_quality"
    year_min: int = 1900
    year_max: int = 2100
    area_min: float = 0.0
    area_max: float = 10000.0
    seasons: tuple[str, ...] = SEASONS
    default_quality: str = "good"
    high_removal_pct: float = 50.0


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` naming every column that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")


def require_rows(df: DataFrame, what: str = "DataFrame") -> None:
    """Raise ``ValueError`` if ``df`` is empty. Runs a job, so operators call it only on request."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
