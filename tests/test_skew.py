"""Quantiles and joins with hot keys, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainledger.functions import quantiles, skew
from rainledger.operators import charts, merging, summaries, trends

PROBS = {"q1": 0.25, "med": 0.5, "p99": 0.99, "top": 1.0}


def groups():
    rng = np.random.default_rng(3)
    return {
        "uniform": rng.uniform(0, 1e4, 3001), "skewed": np.exp(rng.normal(0, 12, 2000)),
        "ties": rng.choice([1.0, 2.0, 2.0, 3.0], 2500), "constant": np.full(900, 7.25),
        "narrow": 1000 + rng.uniform(0, 1e-9, 1500), "negative": rng.normal(0, 1, 1000),
        "outlier": np.append(rng.uniform(0, 1e-6, 1200), [1e300, -1e300]),
        "infinite": np.append(rng.uniform(0, 5, 800), [np.inf] * 30), "mostly infinite": np.array([1.0] * 3 + [np.inf] * 7),
        "small": rng.uniform(0, 5, 12), "one": np.array([4.0]),
    }


def plain_quantile(values, p):
    """Linear interpolation; between equal values, infinities too, there is nothing to interpolate."""
    values, h = np.sort(values), (len(values) - 1) * p
    low, high = values[int(np.floor(h))], values[int(np.ceil(h))]
    return low if low == high or h == np.floor(h) else low + (high - low) * (h - np.floor(h))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(v)) for k, values in groups().items() for v in values] + [("nulls", None)] * 400
    rows += [("uniform", None)] * 10
    return spark.createDataFrame(rows, "k string, v double").repartition(8).cache()


@pytest.mark.parametrize("group_rows", [10**9, 500, 100, 5, 1])
def test_quantiles(table, group_rows):
    got = quantiles.aggregate_with_quantiles(table, ["k"], [F.count("v").alias("n")], "v", PROBS,
                                             group_rows=group_rows)
    got = {r.k: r for r in got.collect()}
    assert set(got) == set(groups()) | {"nulls"}
    assert got["nulls"].n == 0 and got["nulls"].med is None
    for k, values in groups().items():
        assert got[k].n == len(values)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(plain_quantile(values, p), rel=1e-9, abs=1e-12), (k, name)


def passes(monkeypatch):
    seen = []
    real = quantiles._second_pass
    monkeypatch.setattr(quantiles, "_second_pass", lambda *a: seen.append(a[-1]) or real(*a))
    return seen


@pytest.mark.parametrize("probs, group_rows, want", [
    (PROBS, 100, [0]), ({"med": 0.5}, 100, [0]), ({"med": 0.5}, 10**9, [0]), ({"q": 0.3}, 10**9, [0])])
def test_one_second_pass_for_all_groups(table, monkeypatch, probs, group_rows, want):
    seen = passes(monkeypatch)
    quantiles.aggregate_with_quantiles(table, ["k"], [], "v", probs, group_rows=group_rows).collect()
    assert seen == want


def test_medians_of_small_groups_need_no_second_pass(table, monkeypatch):
    seen = passes(monkeypatch)
    small = table.filter("k IN ('constant', 'infinite', 'small', 'one', 'mostly infinite', 'nulls', 'negative')")
    got = {r.k: r.med for r in quantiles.aggregate_with_quantiles(small, ["k"], [], "v", {"med": 0.5}).collect()}
    assert not seen and got["nulls"] is None and len(got) == 7
    for k in got.keys() - {"nulls"}:
        assert got[k] == pytest.approx(plain_quantile(groups()[k], 0.5), rel=1e-9), k


def test_missed_brackets_are_widened(table, monkeypatch):
    """Brackets without width miss their rank; in the end a bracket holds all values."""
    monkeypatch.setattr(quantiles, "WIDTHS", (-0.2, -0.1))
    seen = passes(monkeypatch)
    got = quantiles.aggregate_with_quantiles(table, ["k"], [F.count("v").alias("n")], "v", PROBS, group_rows=100)
    got = {r.k: r for r in got.collect()}
    assert seen == [0, 1, 2]
    for k, values in groups().items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(plain_quantile(values, p), rel=1e-9, abs=1e-12), (k, name)


@pytest.mark.parametrize("group_rows", [10**9, 1])
def test_columns_of_a_whole_table(spark, monkeypatch, group_rows):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, 4000), np.round(rng.uniform(0, 30, 4000))
    df = spark.createDataFrame([(float(x), int(y), None) for x, y in zip(a, b)], "a double, b int, c double")
    seen = passes(monkeypatch)
    row = quantiles.aggregate_columns(df, [], [F.count(F.lit(1)).alias("n")], {
        "a": {"a1": 0.1, "a9": 0.9}, "b": {"b3": 0.3}, "c": {"c5": 0.5}}, group_rows=group_rows).first()
    assert seen == [0] and (row.n, row.c5) == (4000, None)
    assert (row.a1, row.a9, row.b3) == pytest.approx((plain_quantile(a, 0.1), plain_quantile(a, 0.9), plain_quantile(b, 0.3)))
    empty = quantiles.aggregate_columns(df.limit(0), [], [], {"a": {"a1": 0.1}}).collect()
    assert [r.a1 for r in empty] == [None]


def canon(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = [("hot", i % 3, float(i)) for i in range(3000)] + [(f"k{i % 40}", i % 3, float(i)) for i in range(400)]
    left += [(None, 1, 5.0), ("unmatched", 1, 6.0)]
    right = [("hot", y, "h") for y in range(3)] + [(f"k{i}", y, "r") for i in range(30) for y in range(3)]
    right += [("k1", 1, "second"), (None, 1, "null")]
    left = spark.createDataFrame(left, "location_id string, year int, water_area_ha double")
    return left, spark.createDataFrame(right, "location_id string, year int, kind string")


@pytest.mark.parametrize("null_safe", [False, True])
def test_every_join_path_gives_the_same_rows(sides, null_safe):
    left, right = sides
    on = ["location_id", "year"]
    want = canon(skew.skew_join(left, right, on, null_safe=null_safe))
    assert len(want) == 3000 + 400 + 2 + 4  # k1 has a second row in year 1
    for kwargs in ({"max_bytes": 0}, {"max_bytes": 0, "hot_rows": 500}, {"max_bytes": 100, "hot_rows": 500}):
        assert canon(skew.skew_join(left, right, on, null_safe=null_safe, **kwargs)) == want, kwargs
    inner = canon(skew.skew_join(left, right, on, "inner", null_safe=null_safe, max_bytes=0, hot_rows=500))
    assert inner == canon(skew.skew_join(left, right, on, "inner", null_safe=null_safe))


def test_operators_agree_on_both_paths(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"p{i % 50}", 2000 + i % 9, ("winter", "summer")[i % 2],
             float(rng.uniform(0, 9000)), int(i % 20), i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "location_id string, year int, season string, water_area_ha double, "
                               "water_body_count int, pond_presence int").cache()

    def near(a, b):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y)

    for build in (trends.water_trends, summaries.seasonal_summary, summaries.intervention_summary,
                  summaries.describe_numeric, charts.box_stats):
        near(canon(build(df)), canon(build(df, group_rows=100)))


def test_box_stats_with_many_groups(spark):
    df = spark.createDataFrame([(f"s{i % 20}", float(i * i % 997)) for i in range(2000)],
                               "season string, water_area_ha double")
    want = canon(charts.box_stats(df))
    assert len(want) == 20
    assert canon(charts.box_stats(df, group_rows=7)) == want


def test_merge_keeps_rows_beyond_the_broadcast_limit(sides):
    left, right = sides
    right = right.dropDuplicates(["location_id", "year"])
    small = canon(merging.merge_interventions(left, right))
    assert len(small) == left.count()
    assert canon(merging.merge_interventions(left, right, max_broadcast_bytes=0, hot_rows=500)) == small


def test_keys_hot_on_the_right(spark):
    left = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", i) for i in range(300)] + [(None, 9)] * 200 + [("b", 7)], "k string, y int")
    for how in ("left", "inner"):
        for null_safe in (False, True):
            want = canon(skew.skew_join(left, right, ["k"], how, null_safe=null_safe))
            assert canon(skew.skew_join(left, right, ["k"], how, null_safe=null_safe, max_bytes=0, hot_rows=100)) == want
            assert len(want) == 1501 + (200 if null_safe else how == "left") + (how == "left")


def test_measured_bytes(spark):
    df = spark.createDataFrame([("abc", 1, [1, 2]), (None, 2, None)], "a string, b int, c array<int>")
    assert 100 < skew.measured_bytes(df) < 300
    assert skew.measured_bytes(df.limit(0)) == 0
    assert skew.hot_keys(df, ["b"], more_than=1) is None
