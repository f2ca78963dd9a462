"""Operators on the invented panel against plain Python."""

from collections import defaultdict
from statistics import correlation, linear_regression, mean, median, stdev

from panel import invented_panel
from pytest import approx

from rainledger.operators import charts, cleaning, merging, summaries, trends

ROWS = invented_panel()
AREAS = [r[3] for r in ROWS]
PLACE, YEAR, SEASON, AREA, COUNT = range(5)
WITH, WITHOUT = [r for r in ROWS if r[PLACE] == "north"], [r for r in ROWS if r[PLACE] != "north"]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def grouped(*places):
    out = defaultdict(list)
    for r in ROWS:
        out[tuple(r[p] for p in places)].append(r)
    return out


def slope(rows):
    return linear_regression([r[YEAR] for r in rows], [r[AREA] for r in rows]).slope


def areas(rows):
    return [r[AREA] for r in rows]


def test_cleaning_keeps_everything(water):
    assert cleaning.clean_observations(water).count() == len(ROWS)
    r = cleaning.cleaning_report(water).first()
    assert (r.original_records, r.final_records, r.records_removed, r.high_removal) == (len(ROWS), len(ROWS), 0, False)


def test_trends(water):
    got = by(trends.water_trends(water), "location_id", "season")
    want = grouped(PLACE, SEASON)
    assert got.keys() == want.keys()
    for key, rows in want.items():
        r = got[key]
        assert r.mean_water_area_ha == approx(mean(areas(rows))) and r.std_water_area_ha == approx(stdev(areas(rows)))
        assert r.median_water_area_ha == approx(median(areas(rows)))
        assert r.trend_slope_ha_per_year == approx(slope(rows))
        assert (r.trend_quality, r.data_points, r.start_year, r.end_year, r.year_span) == ("good", 4, 2011, 2014, 3)


def test_merge(merged):
    r = merging.merge_report(merged).first()
    assert (r.total_records, r.matched_records, r.match_rate_pct, r.low_match) == (len(ROWS), len(ROWS), 100.0, False)


def test_intervention_summary(merged):
    got = by(summaries.intervention_summary(merged), "pond_presence")
    for flag, rows, name in ((0, WITHOUT, "No Intervention"), (1, WITH, "With Intervention")):
        r = got[flag]
        assert r.water_area_ha_mean == approx(mean(areas(rows))) and r.water_area_ha_median == approx(median(areas(rows)))
        assert r.water_body_count_sum == sum(x[COUNT] for x in rows)
        assert r.location_id_nunique == len({x[PLACE] for x in rows}) and r.intervention_type == name
    base = mean(areas(WITHOUT))
    assert got[0].water_area_increase_pct == 0.0
    assert got[1].water_area_increase_pct == approx((mean(areas(WITH)) - base) / base * 100)


def test_seasonal_summary(water):
    rows = summaries.seasonal_summary(water).collect()
    assert len(rows) == 6
    assert all((r.year_nunique, r.year_span, r.data_quality) == (4, 3, "good") for r in rows)
    assert all(r.data_completeness == approx(4 / 3) for r in rows)


def test_yearly_and_insights(merged):
    yearly = {k[0]: mean(areas(v)) for k, v in grouped(YEAR).items()}
    assert {r.year: r.water_area_ha for r in charts.yearly_mean(merged).collect()} == approx(yearly)
    seasons = {k[0]: mean(areas(v)) for k, v in grouped(SEASON).items()}
    found = {r.insight: r for r in summaries.key_insights(merged).collect()}
    assert found["trend"].level == "increasing"
    assert found["trend"].value == approx(linear_regression(list(yearly), list(yearly.values())).slope)
    assert found["highest_season"].level == max(seasons, key=seasons.get)
    assert found["lowest_season"].level == min(seasons, key=seasons.get)
    ratio = mean(areas(WITH)) / mean(areas(WITHOUT))
    assert found["pond_effect"].value == approx(ratio)
    assert found["pond_effect"].level == ("higher" if ratio > 1.2 else "lower" if ratio < 0.8 else "similar")
    assert found["data_quality"].level == "high"


def test_report_metrics(merged):
    got = {r.metric: r.value for r in summaries.summary_metrics(merged).collect()}
    assert got == {
        "Total Records": str(len(ROWS)), "Unique Locations": "3", "Year Range": "2011-2014",
        "Mean Water Area (ha)": f"{mean(AREAS):.2f}", "Max Water Area (ha)": f"{max(AREAS):.2f}",
        "Min Water Area (ha)": f"{min(AREAS):.2f}", "Records with Pond": str(len(WITH)),
        "Records without Pond": str(len(WITHOUT))}
    quick = {r.metric: r.value for r in summaries.quick_stats(merged).collect()}
    assert quick == {
        "Total Locations": "3", "Year Range": "2011-2014", "Total Records": str(len(ROWS)),
        "Avg Water Area": f"{mean(AREAS):.1f} ha", "Max Water Area": f"{max(AREAS):.1f} ha",
        "Locations with Ponds": "1", "Locations without Ponds": "2"}


def test_correlation(merged):
    got = {(r.column_a, r.column_b): r.correlation for r in summaries.correlation(merged).collect()}
    assert got["pond_presence", "water_area_ha"] == got["water_area_ha", "pond_presence"]
    assert got["pond_presence", "water_area_ha"] == approx(correlation([float(r[PLACE] == "north") for r in ROWS], AREAS))
    assert got["pond_presence", "pond_presence"] == approx(1.0)


def test_slopes_by_intervention(merged):
    got = by(trends.trend_by_intervention(merged), "pond_presence")
    slopes = {k: slope(v) for k, v in grouped(PLACE, SEASON).items()}
    assert got[1].mean_slope_ha_per_year == approx(mean(v for k, v in slopes.items() if k[0] == "north"))
    assert got[0].mean_slope_ha_per_year == approx(mean(v for k, v in slopes.items() if k[0] != "north"))
    assert (got[1].groups, got[0].groups) == (2, 4)


def test_comparison_without_counts(spark):
    rows = [("a", 64, 1), ("b", 31, 0), ("a", 78, 1), ("b", 45, 0)]
    ponds = spark.createDataFrame(rows, "location_id string, water_area_ha int, pond_presence int")
    got = by(summaries.intervention_summary(ponds), "pond_presence")
    assert (got[1].water_area_ha_mean, got[0].water_area_ha_mean) == (mean((64, 78)), mean((31, 45)))
    assert "water_body_count_mean" not in got[1].asDict()
