"""Edge cases of joins, trends, summaries and chart tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException
from pytest import approx

from rainledger.operators import charts, merging, summaries, trends

PANEL = "location_id string, year int, season string, water_area_ha double"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def series(name, pairs):
    return [(name, year, "winter", area) for year, area in pairs]


def test_merge_edges(spark):
    water = spark.createDataFrame([("V001", 2020, "good"), ("V001", 2021, "good"), (None, 2020, "good")],
                                  "location_id string, year int, data_quality string")
    nrm = spark.createDataFrame([("V001", 2020, 1, "x"), ("V001", 2020, 0, "y")],
                                "location_id string, year int, pond_presence int, data_quality string")
    got = merging.merge_interventions(water, nrm)
    assert got.columns == ["location_id", "year", "data_quality", "pond_presence", "data_quality_nrm",
                           "nrm_data_available"]
    assert sorted(r.nrm_data_available for r in got.collect()) == [False, False, True, True]
    assert merging.duplicate_keys(nrm).first().duplicate_rows == 1
    empty = merging.merge_interventions(water, nrm.limit(0))
    assert empty.count() == 3 and empty.filter("nrm_data_available or pond_presence is not null").isEmpty()
    assert merging.merge_report(empty).first().low_match is True
    for call in (lambda: merging.merge_interventions(water, nrm, []),
                 lambda: merging.merge_interventions(water, nrm, ["nope"]),
                 lambda: merging.merge_interventions(water.limit(0), nrm, strict=True)):
        with pytest.raises(ValueError):
            call()


def test_trend_labels(spark):
    nan = float("nan")
    rows = (series("one", [(2020, 5.0)]) + series("same2", [(2020, 1.0), (2020, 3.0)])
            + series("two", [(2020, 1.0), (2022, 5.0)]) + series("same3", [(2020, 1.0), (2020, 2.0), (2020, 6.0)])
            + series("line", [(y, 7 + 2.5 * y) for y in range(2000, 2010)])
            + series("zero", [(2020, 0.0), (2021, 0.0), (2022, 0.0)])
            + series("partly", [(2020, 1.0), (2021, -9.0), (2022, nan), (2023, 4.0)])
            + series("no_value", [(2020, nan), (2021, None), (2022, -1.0)])
            + series("no_year", [(2020, 1.0), (None, 2.0), (2022, 3.0)])
            + series("bad_no_year", [(2020, 1.0), (None, -2.0), (2022, 3.0)])
            + [(None, 2020, "winter", 1.0), ("k", 2020, None, 1.0)])
    df = panel(spark, rows)
    got = {r.location_id: r for r in trends.water_trends(df).collect()}
    assert set(got) == {"one", "same2", "two", "same3", "line", "zero", "partly", "bad_no_year"}
    assert got["one"].std_water_area_ha is None and got["one"].coefficient_of_variation is None
    assert [got[k].trend_quality for k in ("one", "same2", "two", "same3", "line")] == [
        "insufficient_data", "insufficient_data", "minimal_data", "insufficient_data", "good"]
    assert (got["same3"].trend_slope_ha_per_year, got["two"].trend_slope_ha_per_year) == (0.0, approx(2.0))
    assert got["line"].trend_slope_ha_per_year == approx(2.5)
    assert got["zero"].coefficient_of_variation == 0.0
    p = got["partly"]
    assert (p.data_points, p.total_observations, p.trend_quality, p.year_span) == (2, 4, "minimal_data", 3)
    s = trends.trend_summary(df).first()
    assert (s.groups_processed, s.successful_groups) == (10, 5)
    assert s.success_rate_pct == approx(50.0)
    slopes = {r.location_id: r.trend_slope_ha_per_year for r in trends.trend_slopes(df).collect()}
    assert slopes == approx({k: r.trend_slope_ha_per_year for k, r in got.items()})
    with pytest.raises(ValueError):
        trends.water_trends(df, [])
    with pytest.raises(ValueError):
        trends.water_trends(df.limit(0), strict=True)


def test_year_over_year(spark):
    df = panel(spark, series("a", [(2020, 10.0), (2020, 20.0), (2021, 30.0), (2023, 0.0), (2024, 5.0)]))
    got = [(r.year, r.change_ha, r.change_pct) for r in trends.yoy_change(df).orderBy("year").collect()]
    assert got == [(2020, None, None), (2021, 15.0, 100.0), (2023, -30.0, -100.0), (2024, 5.0, None)]


def test_seasonal_labels(spark):
    rows = (series("n1", [(2020, 5.0)]) + series("n3", [(2020, 5.0), (2020, 6.0), (2020, 7.0)])
            + series("gaps", [(2000, 5.0), (2010, 6.0), (2010, 7.0)])
            + series("wild", [(2020, 0.0), (2021, 0.0), (2022, 100.0)])
            + series("wild_gaps", [(2000, 0.0), (2020, 0.0), (2020, 100.0)])
            + series("few", [(2020, 1.0), (2021, 1.0)]) + series("zero", [(2020, 0.0), (2021, 0.0), (2022, 0.0)])
            + series("no_year", [(None, 1.0), (None, 2.0), (None, 3.0)]) + [(None, 2020, "winter", 1.0)])
    got = {r.location_id: r for r in summaries.seasonal_summary(panel(spark, rows)).collect()}
    assert {k: r.data_quality for k, r in got.items()} == {
        "n1": "limited_data", "n3": "good", "gaps": "gaps_in_data", "wild": "high_variability",
        "wild_gaps": "gaps_in_data", "few": "limited_data", "zero": "good", "no_year": "gaps_in_data"}
    assert math.isinf(got["n1"].data_completeness) and got["gaps"].data_completeness == approx(0.2)
    assert got["zero"].water_area_ha_cv == 0.0 and got["n1"].water_area_ha_cv == 0.0
    assert got["few"].data_completeness == 2.0 and got["no_year"].data_completeness == 0.0


def test_missing_flags_have_three_meanings(spark):
    df = spark.createDataFrame(
        [("a", 2020, "winter", 10.0, 1), ("b", 2020, "winter", 4.0, 0), ("c", 2020, "winter", 6.0, None)],
        PANEL + ", pond_presence int")
    full = {r.pond_presence: r for r in summaries.intervention_summary(df).collect()}
    assert full[0].water_area_ha_mean == 5.0 and full[1].water_area_increase_pct == approx(100.0)
    known = {r.pond_presence: r for r in summaries.intervention_summary(df, unmatched="drop").collect()}
    assert known[0].water_area_ha_mean == 4.0
    series_rows = {r.pond_presence: r.water_area_ha for r in charts.comparison_series(df).collect()}
    assert series_rows == {"With Intervention": 10.0, "Without Intervention": 4.0}
    metrics = {r.metric: r.value for r in summaries.summary_metrics(df).collect()}
    assert (metrics["Records with Pond"], metrics["Records without Pond"]) == ("1", "2")
    quick = {r.metric: r.value for r in summaries.quick_stats(df).collect()}
    assert (quick["Locations with Ponds"], quick["Locations without Ponds"]) == ("1", "1")
    for flag in (0, 1):
        only = summaries.intervention_summary(df.filter(f"pond_presence = {flag}")).first()
        assert only.water_area_increase_pct is None
    with pytest.raises(ValueError):
        summaries.intervention_summary(df, "nope")


def test_metrics_without_their_columns(spark):
    df = spark.createDataFrame([(5.0,), (7.0,)], "water_area_ha double")
    metrics = {r.metric: r.value for r in summaries.summary_metrics(df).collect()}
    assert metrics == {"Total Records": "2", "Unique Locations": "N/A", "Year Range": "N/A",
                       "Mean Water Area (ha)": "6.00", "Max Water Area (ha)": "7.00", "Min Water Area (ha)": "5.00"}
    quick = {r.metric: r.value for r in summaries.quick_stats(df).collect()}
    assert (quick["Total Locations"], quick["Avg Water Area"], quick["Locations with Ponds"]) == ("N/A", "6.0 ha", "N/A")


def test_insight_edges(spark):
    tied = panel(spark, [("a", 2020, "winter", 5.0), ("a", 2020, "monsoon", 5.0)])
    got = {r.insight: r.level for r in summaries.key_insights(tied).collect()}
    assert got == {"highest_season": "monsoon", "lowest_season": "monsoon"}
    bare = tied.select("water_area_ha")
    assert [r.insight for r in summaries.key_insights(bare).collect()] == ["none"]
    falling = spark.createDataFrame([(2020, 9.0, 1, "good"), (2021, 5.0, 0, "poor"), (2022, 1.0, 0, None)],
                                    "year int, water_area_ha double, pond_presence int, data_quality string")
    got = {r.insight: r for r in summaries.key_insights(falling).collect()}
    assert (got["trend"].level, got["pond_effect"].level, got["data_quality"].level) == ("declining", "higher", "low")
    assert got["data_quality"].value == approx(100 / 3)


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 9.0)], "pond_presence int, water_area_ha double")
    got = {(r.column_a, r.column_b): r.correlation for r in summaries.correlation(df).collect()}
    assert got["pond_presence", "water_area_ha"] is None and got["water_area_ha", "water_area_ha"] == approx(1.0)


def test_describe(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", None), (4, "z", 8.0)], "a int, t string, b double")
    got = {r.column: r for r in summaries.describe_numeric(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["count"], got["a"].p50, got["a"].p75, got["b"]["count"], got["b"].p25) == (3, 2.0, 3.0, 2, 3.5)
    with pytest.raises(ValueError):
        summaries.describe_numeric(df.select("t"))


def test_pivots(spark):
    df = panel(spark, [("a", 2020, "winter", 1.0), ("a", 2020, "summer", 2.0), ("b", 2020, "winter", 3.0),
                       ("a", 2021, "odd", 9.0)])
    got = {r.year: r for r in charts.seasonal_pivot(df).collect()}
    assert got[2020].asDict() == {"year": 2020, "perennial": 0.0, "winter": 2.0, "monsoon": 0.0, "summer": 2.0}
    one = {r.year: r for r in charts.seasonal_pivot_location(df, "a").collect()}
    assert (one[2020].winter, one[2020].summer, one[2021].winter) == (1.0, 2.0, 0.0)
    with pytest.raises(PySparkException, match="more than one row"):
        charts.seasonal_pivot_location(df.unionByName(df), "a").collect()
    with pytest.raises(ValueError, match="available.*a"):
        charts.seasonal_pivot_location(df, "zz", check=True)
    heat = {r.location_id: r for r in charts.heatmap_pivot(df).collect()}
    assert heat["a"]["2020"] == 1.5 and heat["b"]["2021"] is None
    many = spark.range(700).select(F.lit("a").alias("location_id"), F.col("id").cast("int").alias("year"), F.lit(1.0).alias("water_area_ha"))
    assert len(charts.heatmap_pivot(many).columns) == 701


def test_histogram(spark):
    df = spark.createDataFrame([("w", float(i)) for i in range(101)] + [("s", 100.0), ("s", None), (None, 5.0)],
                               "season string, water_body_count double")
    rows = charts.body_count_histogram(df, bins=10).collect()
    assert sum(r.records for r in rows) == 102
    assert {r.bin for r in rows if r.season == "s"} == {9}
    assert {(r.bin, r.records) for r in rows if r.season == "w"} == {(b, 10) for b in range(9)} | {(9, 11)}
    one = charts.body_count_histogram(df, "s", bins=10).collect()
    assert [(r.bin, r.records, r.bin_start) for r in one] == [(0, 1, 100.0)]


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    r = charts.box_stats(panel(spark, [("a", 2020, "winter", v) for v in values])).first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_rankings(spark):
    df = panel(spark, [(k, 2020, "winter", float(i)) for i, k in enumerate("ccbbaad")])
    assert [r.location_id for r in charts.top_locations(df, 2).collect()] == ["a", "b"]
    assert charts.dashboard_locations(df, k=2).count() == 4
    assert charts.dashboard_locations(df, ["d", "c"]).count() == 3
    assert {r.location_id for r in charts.dashboard_panel(df, ["d", "c", "b", "a"]).collect()} == {"b", "c", "d"}
    assert charts.bubble_radius(df, "d").first().radius == approx(math.sqrt(6) / 10)
    nulls_last = panel(spark, [(None, 1, "s", 1.0), ("a", 1, "s", 1.0)])
    assert charts.head_n(nulls_last, 1).first().location_id == "a"


def test_years_and_flags_as_text(spark):
    rows = [("a", "2019", "winter", 4.0, "yes"), ("a", "2020", "winter", 6.0, "1.0"), ("a", " 2021", "winter", 8.0, " No "),
            ("a", "2022", "winter", 2.0, "maybe"), ("a", "2023", "winter", 3.0, None)]
    df = spark.createDataFrame(rows, "location_id string, year string, season string, water_area_ha double, pond_presence string")
    summary = summaries.seasonal_summary(df).first()
    assert (summary.year_min, summary.year_max, summary.year_nunique) == (2019, 2023, 5)
    series = charts.comparison_series(df).collect()
    assert sorted((r.year.strip(), r.pond_presence) for r in series if r.pond_presence) == [
        ("2019", "With Intervention"), ("2020", "With Intervention"), ("2021", "Without Intervention")]
    compared = {r.pond_presence: r.water_area_ha_count for r in summaries.intervention_summary(df).collect()}
    assert compared == {0: 3, 1: 2}
    slopes = {r.pond_presence: r.mean_slope_ha_per_year for r in trends.trend_by_intervention(df).collect()}
    assert slopes == {1: 2.0, 0: 0.0}


def plain_round_bins(values, bins):
    """Start and step by trying every step of the ladder."""
    low, high, whole = min(values), max(values), all(v == math.floor(v) for v in values)
    shift = 0.5 if whole else 0.0
    if low == high:
        return math.floor(low) - shift, 1.0
    for step in sorted(m * 10.0 ** k for k in range(-9, 9) for m in (1, 2, 5)):
        start = math.floor(low / step) * step - shift
        if (not whole or step >= 1) and math.floor((high - start) / step) < bins:
            return start, step


@pytest.mark.parametrize("values, bins", [
    ([1, 2, 3, 7], 30), ([0, 59], 30), ([0, 60], 30), ([3, 3, 3], 30), ([-7, 1000], 10), ([0.5, 99.75, 3.25], 30), ([2.5], 30),
    ([0.001, 0.0019], 7), ([1e3, 1e4], 9), ([0.0, 3e7, 1e-3], 30), ([-0.25, 0.25], 2), ([1.0, 2.0, 30.0], 30), ([10, 20, 30, 40], 3)])
def test_round_bins(spark, values, bins):
    start, step = plain_round_bins(values, bins)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "water_area_ha double")
    got = {r.bin: (r.bin_start, r.bin_end, r.records) for r in charts.area_histogram(df, bins=bins, round_edges=True).collect()}
    want = Counter(math.floor((v - start) / step) for v in values)
    assert {b: n for b, (_, _, n) in got.items()} == want and max(want) < bins
    for b, (low, high, _) in got.items():
        assert (low, high) == pytest.approx((start + b * step, start + (b + 1) * step))


def test_scatter_sample_and_grid(spark):
    rows = [(f"v{i % 7}", 2000 + i % 5, float(i), float(i * i % 101), i % 3 if i % 3 < 2 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "location_id string, year int, water_area_ha double, crop_yield_ton_per_ha double, pond_presence int")
    every, some = charts.impact_scatter(df), charts.impact_scatter(df, n=40)
    assert every.count() == 900 and some.columns == every.columns
    points = sorted(map(tuple, some.collect()), key=repr)
    assert Counter(p[-1] for p in points) == {"With Intervention": 40, "Without Intervention": 40, None: 40}
    assert points == sorted(map(tuple, charts.impact_scatter(df.repartition(13), n=40).collect()), key=repr)
    assert set(points) <= set(map(tuple, every.collect()))
    grid = charts.impact_grid(df, cells=5).collect()
    assert sum(r.records for r in grid) == 900 and all(0 <= r.x_cell < 5 and 0 <= r.y_cell < 5 for r in grid)
    assert charts.impact_grid(df.limit(0)).count() == 0 and charts.impact_scatter(df, n=1000).count() == 900
