"""Edge cases of cleaning, coercion and reports."""

import pytest
from pyspark.sql import functions as F

from rainledger.functions import coerce
from rainledger.operators import cleaning
from rainledger.schema import Rules

TEXT = "location_id string, year string, season string, water_area_ha string, water_body_count string"
GOOD = ("V1", "2020", "winter", "5.5", "3")


def row(**changes):
    names = ("location_id", "year", "season", "water_area_ha", "water_body_count")
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD))


CASES = [
    (row(), None), (row(year="1899"), "year_out_of_range"), (row(year="1900"), None), (row(year="2100"), None),
    (row(year="2101"), "year_out_of_range"), (row(year=None), "missing_value"), (row(year="abc"), "missing_value"),
    (row(year="2020.0"), None), (row(year=" 2020 "), None), (row(year="2020.5"), "year_not_whole"),
    (row(season="Monsoon"), "invalid_season"), (row(season=None), "invalid_season"),
    (row(water_area_ha="-0.1"), "area_out_of_range"), (row(water_area_ha="0"), None),
    (row(water_area_ha="10000"), None), (row(water_area_ha="10000.1"), "area_out_of_range"),
    (row(water_area_ha="nan"), "missing_value"), (row(water_area_ha="12d"), "missing_value"),
    (row(water_area_ha="12f"), "missing_value"), (row(water_area_ha="0x1p3"), "missing_value"),
    (row(water_area_ha="inf"), "area_out_of_range"), (row(water_area_ha="-Infinity"), "area_out_of_range"),
    (row(water_area_ha="1e3"), None), (row(water_area_ha=".5"), None), (row(water_area_ha=""), "missing_value"),
    (row(water_body_count="-1"), "invalid_body_count"), (row(water_body_count=None), "invalid_body_count"),
    (row(water_body_count="0"), None), (row(location_id=None), None),
    # the first broken rule counts
    (row(year="1800", season="x", water_area_ha="-1"), "year_out_of_range"),
    (row(season="x", water_area_ha="-1"), "invalid_season"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(str(i), *r) for i, (r, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "id string, " + TEXT)


def test_each_row_is_kept_or_rejected_with_its_reason(raw):
    kept = {int(r.id) for r in cleaning.clean_observations(raw).collect()}
    rejected = {int(r.id): r.reason for r in cleaning.rejected_observations(raw).collect()}
    assert kept == {i for i, (_, reason) in enumerate(CASES) if reason is None}
    assert rejected == {i: reason for i, (_, reason) in enumerate(CASES) if reason}


def test_report_counts_every_row_once(raw):
    twice = raw.unionByName(raw)
    r = cleaning.cleaning_report(twice).first().asDict()
    want = [reason for _, reason in CASES]
    assert r["original_records"] == 2 * len(CASES)
    for reason in cleaning.OBSERVATION_REASONS:
        assert r[reason] == 2 * want.count(reason), reason
    assert r["duplicate"] == r["final_records"] == want.count(None)
    assert r["records_removed"] + r["final_records"] == r["original_records"]
    assert r["high_removal"] is True


def test_report_of_nothing(raw):
    r = cleaning.cleaning_report(raw.limit(0)).first()
    assert (r.original_records, r.final_records, r.removal_rate_pct, r.high_removal) == (0, 0, 0.0, False)


def test_cleaning_again_changes_nothing(raw):
    once = cleaning.clean_observations(raw)
    again = cleaning.clean_observations(once)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert dict(again.dtypes)["year"] == "int"


def test_numbers_that_are_not_numbers(spark):
    nan = float("nan")
    rows = [("V1", 2020.0, "winter", 1.0, 1.0), ("V1", 2020.0, "winter", nan, 1.0),
            ("V1", 2020.0, "winter", 1.0, nan), ("V1", nan, "winter", 1.0, 1.0), ("V1", 2020.5, "winter", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "location_id string, year double, season string, water_area_ha double, "
                               "water_body_count double")
    assert cleaning.clean_observations(df).count() == 1
    reasons = sorted(r.reason for r in cleaning.rejected_observations(df).collect())
    assert reasons == ["invalid_body_count", "missing_value", "missing_value", "year_not_whole"]


def test_optional_columns(spark):
    df = spark.createDataFrame([("V1", 2020, "winter", 1.0)] * 2,
                               "location_id string, year int, season string, water_area_ha double")
    assert cleaning.clean_observations(df).collect() == [("V1", 2020, "winter", 1.0, "good")]
    with pytest.raises(ValueError, match="season"):
        cleaning.clean_observations(df.drop("season"))
    with pytest.raises(ValueError, match="empty"):
        cleaning.clean_observations(df.limit(0), strict=True)


def test_other_rules(spark):
    df = spark.createDataFrame([("a", 5, "wet", 20.0), ("a", 6, "dry", 2.0)],
                               "place string, t int, season string, level double")
    rules = Rules(location="place", year="t", area="level", year_min=1, year_max=9, area_max=10, seasons=("wet", "dry"))
    assert [r.level for r in cleaning.clean_observations(df, rules).collect()] == [2.0]


def test_flags(spark):
    texts = ["Yes", " TRUE ", "1", "1.0", "present", "maybe", "2", None, "No", "none", "\tY\n"]
    df = spark.createDataFrame([(t,) for t in texts], "f string")
    assert [r[0] for r in df.select(coerce.normalize_flag(F.col("f"))).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1]
    got = [r[0] for r in df.select(coerce.aggregate_flag(df, "f")).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1]
    known = [r[0] for r in df.select(coerce.known_flag(df, "f")).collect()]
    assert known == [1, 1, 1, 1, 1, None, None, None, 0, 0, 1]
    numbers = spark.createDataFrame([(x,) for x in (2.0, 0.5, -1.0, None, float("nan"), 1.0)], "f double")
    assert [r[0] for r in numbers.select(coerce.aggregate_flag(numbers, "f")).collect()] == [1, 0, 0, 0, 0, 1]
    assert [r[0] for r in numbers.select(coerce.normalize_flag(F.col("f"))).collect()] == [0, 0, 0, 0, 0, 1]
    truth = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r[0] for r in truth.select(coerce.normalize_flag(F.col("f"))).collect()] == [1, 0, 0]


def test_interventions(spark):
    df = spark.createDataFrame(
        [("V001", 2020, "Yes", " Pond"), ("V002", 2021, "No", "Terrace"), (None, 2020, "Yes", "pond"),
         ("V001", 2020, "Yes", " Pond"), ("V003", 1800, "Yes", None), ("V004", None, None, None)],
        "`Location ID` string, Year int, `Pond-Presence` string, `Intervention Type` string")
    clean = cleaning.clean_interventions(df)
    assert clean.columns == ["location_id", "year", "pond_presence", "intervention_type"]
    assert sorted(map(tuple, clean.collect())) == [("V001", 2020, 1, "pond"), ("V002", 2021, 0, "terrace")]
    r = cleaning.interventions_report(df).first()
    assert (r.original_records, r.year_out_of_range, r.missing_value, r.duplicate, r.final_records) == (6, 1, 2, 1, 2)
    assert cleaning.unknown_categories(clean).collect() == [("terrace", 1)]


def test_headers(spark):
    with pytest.raises(ValueError, match="collide"):
        coerce.normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_distinct_and_concat(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, v int")
    assert cleaning.distinct_rows(df).count() == 2
    both = cleaning.concat_locations(df, df.select("k"))
    assert both.count() == 6 and both.columns == ["k", "v"]
    with pytest.raises(ValueError):
        cleaning.concat_locations()
