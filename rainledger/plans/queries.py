"""One named query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bitmaps import distinct_rollup
from ..functions.coerce import capitalize, coerce_numeric, normalize_columns, normalize_flag, split_list
from ..operators import charts, cleaning, merging, prepared, summaries, trends
from ..sinks import versions
from ..sinks.shared import shared_folder
from ..sinks.table import ordered, write_table
from ..sources import documents, tables
from ..streaming import state
from .views import Views

COMPARED = ("location_id", "pond_presence", "water_area_ha", "water_body_count")
Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to four decimals, so that engines adding in another order agree.

    The small shift keeps values that lie on a rounding boundary from falling on either side of it.
    """
    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return (F.round(c + 1e-9, 4) + 0.0 if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*[value(f) for f in df.schema.fields])


def _csv_roundtrip(v: Views, df: DataFrame, name: str) -> str:
    return write_table(df, shared_folder(v.spark), name, "csv", allow_empty=True)


def _src_water_csv(v: Views) -> DataFrame:
    return tables.read_observations(v.spark, _csv_roundtrip(v, v.water_text, "water"))


def _src_nrm_csv(v: Views) -> DataFrame:
    raw = v.nrm_raw.withColumn("Intervention Type", F.coalesce("Intervention Type", F.lit("N/A")))
    return tables.read_interventions(v.spark, _csv_roundtrip(v, raw, "nrm"))


def _src_encoding_fallback(v: Views) -> DataFrame:
    place = F.concat(F.lit("Sã"), F.col("s_suppkey").cast("string"))
    raw = v.table("supplier").select(place.alias("location_id"), F.lit("1999").alias("year"),
                                     F.col("s_name").alias("note"))
    target = f"{shared_folder(v.spark)}/mixed"
    kind = F.pmod(F.xxhash64("location_id"), F.lit(3))
    turned = raw.select("note", "year", "location_id")
    for part, df, encoding in ((0, raw, "UTF-8"), (1, raw, tables.LATIN1), (2, turned, "UTF-8")):
        df.filter(kind == part).write.mode("append").option("header", True).option("encoding", encoding).csv(target)
    return tables.read_interventions(v.spark, target)


def _sink_roundtrip(v: Views) -> DataFrame:
    target = write_table(v.grain, shared_folder(v.spark), "by year", "parquet", partition_by=["year"],
                         allow_empty=True)
    return v.spark.read.parquet(target)


def _sink_versions(v: Views) -> DataFrame:
    """The newest of three versions, of which the last was made from the one before it."""
    root = shared_folder(v.spark)
    versions.write_version(v.grain.filter("year < 1996"), root)
    versions.write_version(v.grain, root, partition_by=("year",))
    versions.write_version(versions.read_version(v.spark, root), root)
    versions.remove_old_versions(v.spark, root, keep=1)
    return versions.read_version(v.spark, root)


def _merge_prepared(v: Views) -> DataFrame:
    layouts = prepared.prepare_merge(v.stored(v.water), v.stored(v.nrm), shared_folder(v.spark), buckets=16)
    return prepared.merge_prepared(v.spark, *layouts)


def _json_rejects(v: Views) -> DataFrame:
    return documents.document_rejects(v.documents).groupBy("reason", "position").agg(
        F.count(F.lit(1)).alias("records"))


def _spatial_units(v: Views) -> DataFrame:
    units = documents.spatial_units(v.unit_documents, " Village ", "State 3")
    return units.select("id", "name", "type", "state", F.element_at("extras", "code").alias("code"))


def _coerce_numeric(v: Views) -> DataFrame:
    return coerce_numeric(v.water_text, "water_area_ha", "year").groupBy("year").agg(
        F.count(F.lit(1)).alias("records"), F.count("water_area_ha").alias("numbers"),
        F.max("water_area_ha").alias("largest"))


def _split_list(v: Views) -> DataFrame:
    text = F.concat_ws(",", F.col("s_name"), F.lit(" "), F.concat(F.lit(" n"), F.col("s_nationkey")))
    return v.table("supplier").select(F.explode(split_list(text)).alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("records"))


def _normalize_flag(v: Views) -> DataFrame:
    flag = normalize_flag(F.col("Pond-Presence"))
    return v.nrm_raw.groupBy(F.col("Pond-Presence").alias("raw"), flag.alias("flag")).agg(
        F.count(F.lit(1)).alias("records"))


def _duplicate_keys(v: Views) -> DataFrame:
    orders = v.table("orders").select(F.col("o_custkey").alias("location_id"), F.year("o_orderdate").alias("year"))
    return merging.duplicate_keys(orders)


def _merge_fanout(v: Views) -> DataFrame:
    """Right side with repeated keys and an overlapping column; matched rows are counted."""
    right = v.nrm.unionByName(v.nrm).withColumn("data_quality", F.lit("survey"))
    merged = merging.merge_interventions(v.water, right)
    return merged.groupBy("season", "nrm_data_available", "data_quality_nrm").agg(
        F.count(F.lit(1)).alias("records"))


def _grain_of_top(v: Views) -> DataFrame:
    return charts.dashboard_panel(v.grain)


def _by_region(v: Views) -> DataFrame:
    """Seasonal summary one level up; the place table is joined behind a size check."""
    placed = merging.merge_interventions(v.water, v.places, ["location_id"]).drop("nrm_data_available")
    return summaries.seasonal_summary(v.stored(placed), "region")


def _value_distribution(v: Views) -> DataFrame:
    quality = summaries.value_distribution(trends.trend_slopes(v.water), "trend_quality")
    pond = summaries.value_distribution(v.nrm, "pond_presence")
    kind = summaries.value_distribution(v.nrm, "intervention_type")
    parts = [df.select(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"), "records")
             for df, name in ((quality, "trend_quality"), (pond, "pond_presence"), (kind, "intervention_type"))]
    return cleaning.concat_locations(*parts)


def _seasonal_quality(v: Views) -> DataFrame:
    return summaries.value_distribution(summaries.seasonal_summary(v.stored(v.water)), "data_quality")


def _folded(v: Views) -> DataFrame:
    """The state after the observations came in four batches, one of them twice, with a sum in between."""
    water, folder = v.stored(v.water), shared_folder(v.spark)
    for number, batch in enumerate((0, 1, 1, 2, 3)):
        state.fold_batch(water.filter(F.pmod(F.xxhash64("location_id", "year"), F.lit(4)) == batch), batch, folder)
        if number == 2:
            state.compact_state(v.spark, folder)
    return state.read_state(v.spark, folder)


QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    # sources
    "src_water_csv": _src_water_csv,
    "src_nrm_csv": _src_nrm_csv,
    "src_encoding_fallback": _src_encoding_fallback,
    "json_flatten": lambda v: documents.flatten_timeseries(v.documents),
    "json_envelope_rejects": _json_rejects,
    "json_season_rejects": lambda v: documents.season_rejects(v.documents).groupBy("season", "reason").agg(
        F.count(F.lit(1)).alias("records")),
    "load_report": lambda v: documents.load_report(v.documents),
    "load_documents": lambda v: documents.load_observations(v.documents),
    "spatial_units_filter": _spatial_units,
    "elevation_cells": lambda v: documents.elevation_cells(v.elevation_documents),
    "concat_locations": lambda v: cleaning.concat_locations(v.water, v.grain),
    "select_observations": lambda v: tables.select_observations(
        v.water, [" V000001", "V000002", "V000007"], 1996, 1998, ["Monsoon ", "winter"]),
    # sinks
    "sink_roundtrip": _sink_roundtrip,
    "sink_versions": _sink_versions,
    # cleaning
    "clean_water": lambda v: cleaning.clean_observations(v.water_text),
    "clean_report": lambda v: cleaning.cleaning_report(v.water_text.unionByName(v.water_text)),
    "rejected_rows": lambda v: cleaning.rejected_observations(v.water_text),
    "clean_nrm": lambda v: v.nrm,
    "clean_nrm_report": lambda v: cleaning.interventions_report(v.nrm_raw.unionByName(v.nrm_raw)),
    "normalize_columns": lambda v: normalize_columns(v.nrm_raw),
    "normalize_flag": _normalize_flag,
    "unknown_categories": lambda v: cleaning.unknown_categories(v.nrm),
    "coerce_numeric": _coerce_numeric,
    "split_list": _split_list,
    "distinct_rows": lambda v: cleaning.distinct_rows(v.water_raw.select("location_id", "year", "season")),
    # joins
    "merge_left": lambda v: v.merged,
    "merge_prepared": _merge_prepared,
    "merge_none": lambda v: merging.without_interventions(v.water),
    "merge_report": lambda v: merging.merge_report(v.merged),
    "merge_fanout": _merge_fanout,
    "duplicate_keys": _duplicate_keys,
    # aggregates
    "trend_by_location_season": lambda v: trends.water_trends(
        v.stored(v.water, "location_id", "season", "year", "water_area_ha")),
    "trend_by_season": lambda v: trends.water_trends(
        v.stored(v.water, "season", "year", "water_area_ha"), ["season"]),
    "intervention_summary": lambda v: summaries.intervention_summary(v.stored(v.merged, *COMPARED)),
    "intervention_summary_matched": lambda v: summaries.intervention_summary(
        v.stored(v.merged, *COMPARED), unmatched="drop"),
    "seasonal_summary": lambda v: summaries.seasonal_summary(v.stored(v.water)),
    "seasonal_summary_by_region": _by_region,
    "summary_metrics": lambda v: summaries.summary_metrics(v.merged),
    "quick_stats": lambda v: summaries.quick_stats(v.merged),
    "key_insights": lambda v: summaries.key_insights(v.merged),
    "fetch_summary": lambda v: summaries.fetch_summary(v.water),
    "value_distribution": _value_distribution,
    "seasonal_quality_distribution": _seasonal_quality,
    "seasonal_quality_sparse": lambda v: summaries.value_distribution(
        summaries.seasonal_summary(v.stored(v.sparse)), "data_quality"),
    "seasonal_summary_sparse": lambda v: summaries.seasonal_summary(v.stored(v.sparse)),
    "trend_quality_sparse": lambda v: summaries.value_distribution(trends.trend_slopes(v.sparse), "trend_quality"),
    "trend_incremental": lambda v: state.state_trends(_folded(v)),
    "coverage_incremental": lambda v: state.state_coverage(_folded(v)),
    "distinct_locations_rollup": lambda v: distinct_rollup(v.stored(v.water, "season", "year", "location_id"),
                                                           ["season", "year"], "location_id", "locations"),
    "trend_summary": lambda v: trends.trend_summary(v.water),
    "trend_by_intervention": lambda v: trends.trend_by_intervention(v.merged),
    "correlation": lambda v: summaries.correlation(v.merged),
    "describe_numeric": lambda v: summaries.describe_numeric(v.stored(v.merged)),
    "location_summaries": lambda v: trends.location_summaries(v.water),
    "aggregated_metrics": lambda v: trends.aggregated_metrics(trends.location_summaries(v.water)),
    "yoy_change": lambda v: trends.yoy_change(v.water),
    # charts
    "seasonal_pivot": lambda v: charts.seasonal_pivot(v.water),
    "seasonal_pivot_location": lambda v: charts.seasonal_pivot_location(v.grain, "V000001", check=True),
    "comparison_series": lambda v: charts.comparison_series(v.merged),
    "comparison_text_flag": lambda v: charts.comparison_series(v.merged_text_flag),
    "trend_text_flag": lambda v: trends.trend_by_intervention(v.merged_text_flag),
    "histogram_by_season": lambda v: charts.body_count_histogram(v.water),
    "histogram_round_by_season": lambda v: charts.body_count_histogram(v.water, round_edges=True),
    "area_histogram_round": lambda v: charts.area_histogram(v.water, round_edges=True),
    "heatmap_pivot": lambda v: charts.heatmap_pivot(v.water),
    "heatmap_long": lambda v: charts.heatmap_long(v.water, "water_body_count"),
    "box_stats_all_years": lambda v: charts.box_stats(v.stored(v.water, "season", "year", "water_area_ha")),
    "box_stats": lambda v: charts.box_stats(
        v.stored(v.water, "season", "year", "water_area_ha"), years=(1996, 2000)),
    "impact_scatter": lambda v: charts.impact_scatter(v.merged),
    "impact_scatter_sample": lambda v: charts.impact_scatter(v.merged, n=50),
    "impact_grid": lambda v: charts.impact_grid(v.merged),
    "capitalize": lambda v: v.water.groupBy("season", capitalize(F.col("season")).alias("label")).agg(F.count(F.lit(1)).alias("records")),
    "top_locations": lambda v: charts.top_locations(v.water),
    "dashboard_locations": lambda v: charts.dashboard_locations(v.water),
    "dashboard_seasonal": lambda v: charts.dashboard_seasonal(_grain_of_top(v)),
    "dashboard_body_count": lambda v: charts.dashboard_body_count(charts.dashboard_panel(v.water)),
    "dashboard_yearly_area": lambda v: charts.dashboard_yearly_area(charts.dashboard_panel(v.water)),
    "area_histogram": lambda v: charts.area_histogram(v.water),
    "dashboard_area_histogram": lambda v: charts.area_histogram(charts.dashboard_locations(v.water)),
    "yearly_mean": lambda v: charts.yearly_mean(v.water),
    "bubble_radius": lambda v: charts.bubble_radius(v.water),
    "head_n": lambda v: charts.head_n(v.water, 5),
    "ordered": lambda v: ordered(v.grain, ["location_id", "year", "season"]),
}


def queries() -> dict[str, Query]:
    """Every query as a function of the session and the directory of the tables."""
    def bind(build: Callable[[Views], DataFrame]) -> Query:
        return lambda spark, directory: tidy(build(Views(spark, directory)))

    return {name: bind(build) for name, build in QUERIES.items()}
