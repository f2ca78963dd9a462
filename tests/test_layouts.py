"""Bitmaps of distinct values, tables in versions, and merges of bucketed tables."""

import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rainledger.functions import bitmaps
from rainledger.operators import merging, prepared
from rainledger.sinks import versions


def marks(spark, rows):
    return spark.createDataFrame(rows, "k string, y int, v string")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", [10**9, 0])
def test_distinct_rollup_against_sets(spark, limit):
    rows = [("abc"[i % 3] if i % 7 else None, i % 5, f"v{i * i % 1009}" if i % 11 else None) for i in range(4000)]
    rows += [("a", 1, "hot")] * 3000 + [("z", 9, None)]
    want = Counter()
    for level, key in ((2, lambda r: r[:2]), (1, lambda r: (r[0], None)), (0, lambda r: (None, None))):
        groups = {}
        for r in rows:
            if r[2] is not None:
                groups.setdefault(key(r), set()).add(r[2])
        want += Counter((*k, level, len(v)) for k, v in groups.items())
    got = bitmaps.distinct_rollup(marks(spark, rows).repartition(5), ["k", "y"], "v", max_broadcast_bytes=limit)
    assert rows_of(got) == want


def test_distinct_values_over_many_buckets(spark):
    df = spark.range(0, 200_000, 1, 3).select((F.col("id") % 2).alias("k"), (F.col("id") % 90_001).alias("v"))
    found = bitmaps.distinct_bitmaps(df.unionAll(df), ["k"], "v")
    assert found.filter(f"octet_length({bitmaps.BITMAP}) <> 4096").isEmpty() and found.count() < 20
    assert rows_of(bitmaps.distinct_counts(found, ["k"])) == {(0, 90_001): 1, (1, 90_001): 1}
    assert rows_of(bitmaps.distinct_counts(bitmaps.merged_bitmaps(found, []), [])) == {(90_001,): 1}


def test_bitmaps_of_batches_are_united(spark):
    rows = [("a", 1, f"v{i}") for i in range(50)]
    numbers = bitmaps.value_numbers(marks(spark, rows), "v")
    parts = [bitmaps.distinct_bitmaps(marks(spark, part), ["k"], "v", numbers=numbers) for part in (rows[:30], rows[20:])]
    both = bitmaps.merged_bitmaps(parts[0].unionByName(parts[1]), ["k"])
    assert rows_of(bitmaps.distinct_counts(both, ["k"])) == {("a", 50): 1}


def test_no_values_at_all(spark):
    for rows in ([], [("a", 1, None)]):
        assert rows_of(bitmaps.distinct_rollup(marks(spark, rows), ["k", "y"], "v")) == {(None, None, 0, 0): 1}


def test_versions_are_read_by_number_and_removed(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, root)
    assert [versions.write_version(spark.range(n), root) for n in (1, 2, 3)] == [1, 2, 3]
    held = versions.read_version(spark, root)
    versions.write_version(held.unionAll(held), root)  # made from the version it follows
    assert held.count() == 3 and versions.read_version(spark, root).count() == 6
    assert versions.read_version(spark, root, 2).count() == 2
    assert versions.remove_old_versions(spark, root, keep=2) == [1, 2] and versions.versions(spark, root) == [3, 4]
    assert held.count() == 3 and len(list((tmp_path / "t").glob("rows-*"))) == 2
    assert versions.write_version(spark.range(9), root) == 5
    for number in (0, 1, 77):
        with pytest.raises(ValueError, match="no version"):
            versions.read_version(spark, root, number)
    with pytest.raises(ValueError, match="at least one"):
        versions.remove_old_versions(spark, root, keep=0)


def test_a_writer_killed_at_any_step_is_not_seen(spark, tmp_path, monkeypatch):
    root = tmp_path / "t"
    versions.write_version(spark.range(4), str(root))
    with pytest.raises(Exception, match="stop"):  # among the rows
        versions.write_version(spark.range(4).select(F.raise_error(F.lit("stop")).alias("id")), str(root))
    (root / "rows-left" ).mkdir()  # between rows and pointer
    for n, text in ((2, ""), (3, "rows-left"), (4, "rows-left\n"), (5, "rows-left\ncompl")):  # within the pointer
        (root / "_versions" / f"{n:020d}").write_text(text)
    assert versions.versions(spark, str(root)) == [1] and versions.read_version(spark, str(root)).count() == 4
    assert versions.write_version(spark.range(5), str(root)) == 6
    assert versions.read_version(spark, str(root)).count() == 5
    versions.remove_old_versions(spark, str(root), keep=5)
    assert (root / "rows-left").exists()  # young: its writer may be at work
    versions.remove_old_versions(spark, str(root), keep=5, abandoned_hours=-1)
    assert not (root / "rows-left").exists() and versions.versions(spark, str(root)) == [1, 6]


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    real, gate = versions._numbers, threading.Barrier(3)

    def together(*a):
        found = real(*a)
        gate.wait(timeout=60)
        return found

    got = []
    monkeypatch.setattr(versions, "_numbers", together)
    threads = [threading.Thread(target=lambda n=n: got.append(versions.write_version(spark.range(n), root))) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert sorted(got) == [1, 2, 3]
    assert sorted(versions.read_version(spark, root, n).count() for n in got) == [1, 2, 3]


def sides(spark):
    left = [(f"p{i % 40}" if i % 13 else None, 2000 + i % 3, float(i), "good") for i in range(900)]
    left += [("hot", 2000, float(i), "good") for i in range(700)]
    right = [(f"p{i}", y, i, "survey") for i in range(0, 60, 2) for y in (2000, 2001)]
    right += [("hot", 2000, 1, "a"), ("hot", 2000, 2, "b"), (None, 2000, 3, "c"), ("p0", 2000, 4, "again")]
    right += [("many", 2000, i, "m") for i in range(300)]
    left += [("many", 2000, -1.0, "good"), ("it's", 2001, -2.0, "good")]
    return (spark.createDataFrame(left, "location_id string, year int, area double, quality string").repartition(7),
            spark.createDataFrame(right, "location_id string, year bigint, pond int, quality string").repartition(3))


@pytest.mark.parametrize("hot_rows", [10**6, 200, 5, 0])
@pytest.mark.parametrize("limit", [10**9, 0])
def test_prepared_merge_has_the_rows_of_the_plain_one(spark, tmp_path, hot_rows, limit):
    left, right = sides(spark)
    want = merging.merge_interventions(left, right)
    layouts = prepared.prepare_merge(left, right, str(tmp_path / "it's new"), buckets=4, hot_rows=hot_rows)
    got = prepared.merge_prepared(spark, *layouts, max_broadcast_bytes=limit, hot_rows=hot_rows)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_prepared_merge_moves_no_row(spark, tmp_path):
    left, right = sides(spark)
    layouts = prepared.prepare_merge(left, right, str(tmp_path / "new"), buckets=4)
    files = {p.name.split("_")[-1].split(".")[0] for p in (tmp_path / "new" / "left" / "buckets").glob("part-*")}
    assert len(files) == len(list((tmp_path / "new" / "left" / "buckets").glob("part-*"))) <= 4  # one file per bucket
    df = prepared.merge_prepared(spark, *layouts)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in text and not re.search(r"Exchange|Cartesian|NestedLoop", text)


def test_layouts_must_fit(spark, tmp_path):
    left, right = sides(spark)
    a, _ = prepared.prepare_merge(left, right, str(tmp_path / "a"), buckets=4)
    _, b = prepared.prepare_merge(left, right, str(tmp_path / "b"), buckets=8)
    with pytest.raises(ValueError, match="same keys"):
        prepared.merge_prepared(spark, a, b)
    with pytest.raises(ValueError, match="empty"):
        prepared.prepare_merge(left, right, str(tmp_path / "c"), [])


def test_prepared_merge_of_empty_tables(spark, tmp_path):
    left, right = (df.limit(0) for df in sides(spark))
    layouts = prepared.prepare_merge(left, right, str(tmp_path / "e"), buckets=4)
    assert prepared.merge_prepared(spark, *layouts).isEmpty()
