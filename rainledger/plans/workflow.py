"""The usual sequence of stages, each reading and writing stored tables.

Stages meet in parquet, so column types survive and later stages read only the columns they use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_observations, cleaning_report
from ..operators.merging import duplicate_keys, merge_interventions, merge_report, without_interventions
from ..operators.summaries import intervention_summary, key_insights, seasonal_summary, summary_metrics
from ..operators.trends import water_trends
from ..sinks.table import write_table
from ..sources.documents import flatten_timeseries, read_documents
from ..sources.tables import read_interventions, select_observations


def fetch(spark: SparkSession, landing: str, out: str, locations: Sequence[str], start: int, end: int,
          seasons: Sequence[str] | None = None, name: str = "water_data") -> str:
    """Documents of a landing directory to a cleaned table of the chosen places, years and seasons.

    The cleaning report of the chosen rows is written beside it, as ``<name>_cleaning``.
    """
    rows = flatten_timeseries(read_documents(spark, landing))
    # Selected before duplicates are removed: only chosen rows are shuffled.
    selected = select_observations(rows, locations, start, end, seasons)
    chosen = clean_observations(selected)
    write_table(cleaning_report(selected), out, f"{name}_cleaning", "csv")
    return write_table(chosen, out, name, "parquet", partition_by=["year"])


def merge(spark: SparkSession, water: DataFrame, out: str, nrm_path: str | None = None,
          name: str = "merged_data") -> str:
    """Observations, cleaned again, with intervention records from CSV if there are any.

    A merge is audited: repeated keys of the records and the match rate are written beside the table, as
    ``<name>_repeated_keys`` and ``<name>_match``.
    """
    water = clean_observations(water)
    if nrm_path is None:
        return write_table(without_interventions(water), out, name, "parquet", partition_by=["year"])
    records = read_interventions(spark, nrm_path)
    target = write_table(merge_interventions(water, records), out, name, "parquet", partition_by=["year"])
    write_table(duplicate_keys(records), out, f"{name}_repeated_keys", "csv", allow_empty=True)
    write_table(merge_report(spark.read.parquet(target)), out, f"{name}_match", "csv")
    return target


def analyse(spark: SparkSession, merged_path: str, out: str) -> dict[str, str]:
    """Trends, comparison and seasonal summary of a stored merged table, each as its own table."""
    merged = spark.read.parquet(merged_path)
    results = {"trends": water_trends(merged), "seasonal_summary": seasonal_summary(merged)}
    if "pond_presence" in merged.columns:
        results["intervention_summary"] = intervention_summary(merged)
    return {name: write_table(df, out, name, "parquet", allow_empty=True) for name, df in results.items()}


def report(spark: SparkSession, merged_path: str, out: str) -> dict[str, str]:
    """Metrics and findings of a stored merged table as CSV."""
    merged = spark.read.parquet(merged_path)
    results = {"summary_metrics": summary_metrics(merged), "key_insights": key_insights(merged)}
    return {name: write_table(df, out, name, "csv") for name, df in results.items()}
