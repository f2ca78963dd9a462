"""Properties of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from rainledger.operators import charts, cleaning, merging, summaries, trends
from rainledger.plans import queries as named
from rainledger.plans.views import Views
from rainledger.sources import select_observations

SMALL = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "water")
    Views(spark, SMALL).merged.write.partitionBy("year").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(named.queries()))
def test_no_python_and_no_pairing_of_rows(spark, name):
    text = plan(named.queries()[name](spark, SMALL), "simple")
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_selection_reaches_the_scan(stored):
    text = plan(select_observations(stored, ["V000001"], 1996, 1998, ["winter"]))
    assert re.search(r"PartitionFilters: \[.*year.*>= 1996", text)
    assert re.search(r"PushedFilters: \[.*location_id.*", text) and "season" in text.split("PushedFilters")[1]


def test_cleaning_rules_reach_the_scan(stored):
    text = plan(cleaning.clean_observations(stored))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThanOrEqual(water_area_ha,0.0)" in pushed and "LessThanOrEqual(water_area_ha,10000.0)" in pushed
    assert "In(season" in pushed and "GreaterThanOrEqual(water_body_count,0)" in pushed


def test_only_used_columns_are_read(stored):
    text = plan(trends.trend_slopes(stored))
    assert re.search(r"ReadSchema: struct<location_id:string,season:string,water_area_ha:double>", text)


@pytest.mark.parametrize("build, exchanges", [
    (trends.trend_slopes, 1), (trends.trend_summary, 2), (merging.merge_report, 1),
    (charts.seasonal_pivot, 2), (charts.heatmap_long, 1), (charts.comparison_series, 1),
    (summaries.correlation, 1), (trends.location_summaries, 1), (trends.yoy_change, 2),
    (summaries.summary_metrics, 2), (summaries.quick_stats, 2), (summaries.key_insights, 3),
])
def test_one_scan_and_no_needless_shuffle(stored, build, exchanges):
    text = plan(build(stored), "simple")
    assert text.count("FileScan") == 1
    assert len(re.findall(r"\bExchange\b", text)) <= exchanges, text


@pytest.mark.parametrize("build", [summaries.intervention_summary, summaries.seasonal_summary])
def test_quantiles_are_read_from_stored_aggregates(stored, build):
    text = plan(build(stored), "simple")
    assert text.count("FileScan") <= 2 and "CartesianProduct" not in text
    assert "lineitem" not in text and len(re.findall(r"\bExchange\b", text)) <= 2, text


def test_small_side_is_broadcast_and_the_large_side_stays(spark, stored):
    right = spark.range(10).select(F.concat(F.lit("V"), "id").alias("location_id"), F.lit(1).alias("x"))
    text = plan(merging.merge_interventions(stored, right, ["location_id"]), "simple")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text
