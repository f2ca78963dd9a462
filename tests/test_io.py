"""Readers, JSON documents, writers, the staged workflow and the incremental intake."""

import json

import pytest
from pyspark.sql import functions as F

from rainledger import sources
from rainledger.operators import cleaning, trends
from rainledger.plans import workflow
from rainledger.sinks import clean_filename, ordered, stored, working_tables, write_table
from rainledger.sources import documents, tables
from rainledger.streaming import landing, state


def docs(spark, *bodies):
    rows = [("V1", b if isinstance(b, str) else json.dumps(b)) for b in bodies]
    return spark.createDataFrame(rows, "location_id string, document string")


def flat(spark, *bodies):
    df = documents.flatten_timeseries(docs(spark, *bodies))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def entry(year=2020, **seasons):
    return {"year": year, "seasons": seasons}


def test_document_shapes(spark):
    e = entry(monsoon={"area_ha": 100.5, "count": 5})
    want = [("V1", 2020, "monsoon", 100.5, 5, "good")]
    for body in ({"data": {"timeseries": [e]}}, {"timeseries": [e]}, {"data": [e]}, [e]):
        assert flat(spark, body) == want, body
    for body in ("nope", {"timeseries": 5}, {"data": {"timeseries": {}}}, {}, [], "", {"timeseries": None}):
        assert flat(spark, body) == [], body


@pytest.mark.parametrize("year, read", [
    (2020, 2020), ("2021", 2021), ("02021", 2021), (2022.5, None), (2022.0, None), (True, None), (None, None),
    ("2020.0", None), (" 2020", None), (1899, None), (1900, 1900), (2100, 2100), (2101, None), (-2020, None),
    ([], None), (20200, None)])
def test_years(spark, year, read):
    got = flat(spark, [entry(year, winter={"area_ha": 1})])
    assert [r[1] for r in got] == ([read] if read else [])


def test_only_the_bad_element_is_lost(spark):
    body = {"timeseries": [
        7, None, {"seasons": {}}, {"year": 2020}, {"year": 2020, "seasons": []},
        entry(2021, winter=5, monsoon={"area_ha": "x", "count": "x"}, autumn={"area_ha": 1},
              summer={"area_ha": 20000, "count": 5.7, "quality": "poor"},
              perennial={"area_ha": "3.5", "count": "4", "quality": None}),
        entry(2022, winter={"count": -3, "area_ha": None}, monsoon={"area_ha": True, "count": "5.7"},
              summer={"area_ha": "12d", "count": True}, perennial={}),
    ]}
    assert flat(spark, body) == sorted([
        ("V1", 2021, "monsoon", 0.0, 0, "good"), ("V1", 2021, "summer", 20000.0, 5, "poor"),
        ("V1", 2021, "perennial", 3.5, 4, None), ("V1", 2022, "winter", 0.0, 0, "good"),
        ("V1", 2022, "monsoon", 1.0, 0, "good"), ("V1", 2022, "summer", 0.0, 1, "good"),
        ("V1", 2022, "perennial", 0.0, 0, "good")], key=repr)
    rejects = documents.document_rejects(docs(spark, body)).collect()
    assert sorted((r.position, r.reason) for r in rejects) == [
        (0, "entry_not_object"), (1, "entry_not_object"), (2, "entry_without_year")]


def test_rejected_documents(spark):
    got = documents.document_rejects(docs(spark, "nope", {"data": 5}, [entry("x")], [entry(2020)]))
    assert sorted((r.reason, r.position) for r in got.collect()) == [
        ("invalid_year", 0), ("no_list_of_years", None), ("not_json", None)]


def test_blank_ids_are_skipped_and_others_stripped(spark):
    body = json.dumps([entry(winter={"area_ha": 1})])
    df = spark.createDataFrame([("  ", body), (" V2 ", body), (None, body)], "location_id string, document string")
    assert [r.location_id for r in documents.flatten_timeseries(df).collect()] == ["V2"]


def test_units(spark):
    body = {"data": [{"id": "1", "name": "A", "type": "village", "state": "X", "code": 5},
                     {"id": "2", "name": "B", "type": "village", "state": "Y"}, {"id": "3", "type": "village"},
                     {"id": "4", "name": "D", "type": "block", "state": "X"}, 5]}
    df = docs(spark, body, {"data": {}})
    got = documents.spatial_units(df, "VILLAGE ").collect()
    assert sorted((r.id, r.state, r.extras.get("code")) for r in got) == [("1", "X", "5"), ("2", "Y", None)]
    assert [r.id for r in documents.spatial_units(df, "village", " X ").collect()] == ["1"]
    for args in (("planet",), ("village", " ")):
        with pytest.raises(ValueError):
            documents.spatial_units(df, *args)


def test_elevation(spark):
    df = docs(spark, {"data": {"elevation_grid": [[1, 2.5], ["x"], 7]}}, {"data": {"elevation_grid": 5}}, {"data": 1})
    got = sorted((r.row, r.col, r.elevation) for r in documents.elevation_cells(df).collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.5), (1, 0, None)]


def test_units_and_elevation_that_are_not_strict_json(spark):
    unit = '{"id":"%s","name":"old","name":"N","type":"village","height":%s}'
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    df = docs(spark, '{"data":[%s,%s]}' % (unit % (1, "NaN"), unit % (2, "5")), '{"data":[%s]}' % (unit % (3, "6")))
    got = documents.spatial_units(df).collect()
    assert sorted((r.id, r.name, r.extras["height"]) for r in got) == [("1", "N", None), ("2", "N", "5"), ("3", "N", "6")]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    df = docs(spark, '{"data":{"elevation_grid":[[1,NaN],["NaN",4]]}}', '{"data":{"a":1,"a":2,"elevation_grid":[[],[9]]}}')
    got = [(r.row, r.col, r.elevation) for r in documents.elevation_cells(df).collect()]
    assert sorted(got, key=str) == [(0, 0, 1.0), (0, 1, None), (1, 0, 9.0), (1, 0, None), (1, 1, 4.0)]


def test_csv_null_tokens_and_quotes(spark, tmp_path):
    f = tmp_path / "nrm.csv"
    f.write_text('Location ID,Year,Pond Presence,Intervention-Type,note\n'
                 'V1,2020,Yes,Pond,"a, ""b"""\nV2,N/A,no,,x\nNA,2020,1,pond,x\nV3,2021,null,None,\n')
    got = sources.read_interventions(spark, str(f)).collect()
    assert sorted((r.location_id, r.year, r.pond_presence, r.intervention_type, r.note) for r in got) == [
        ("V1", 2020, 1, "pond", 'a, "b"'), ("V3", 2021, 0, None, None)]


def test_uncleaned_observations_are_typed(spark, tmp_path):
    f = tmp_path / "water.csv"
    f.write_text("location_id,year,season,water_area_ha,water_body_count\nV1,2020,Spring,-5,x\n")
    got = sources.read_observations(spark, str(f), clean=False)
    assert got.collect() == [("V1", 2020, "Spring", -5.0, None)]
    assert sources.read_observations(spark, str(f)).isEmpty()


def test_latin1_fallback(spark, tmp_path):
    text = "location_id,year,note\nV1,2020,São José\n"
    for encoding in ("utf-8", "latin-1"):
        f = tmp_path / f"{encoding}.csv"
        f.write_bytes(text.encode(encoding))
        assert sources.is_utf8(spark, str(f)) == (encoding == "utf-8")
        assert sources.read_interventions(spark, str(f)).first().note == "São José"


def test_directory_of_unlike_files(spark, tmp_path):
    box = tmp_path / "a box"
    box.mkdir()
    (box / "1.csv").write_text("location_id,year,note,crop_yield_ton_per_ha\nA,2020,S\u00e3o,1.5\n", encoding="utf-8")
    (box / "2.csv").write_text("location_id,year,note,crop_yield_ton_per_ha\nB,2021,Jos\u00e9,2.5\n", encoding="latin-1")
    (box / "3.csv").write_text("crop_yield_ton_per_ha,note,location_id,year\n3.5,x,C,2022\n", encoding="utf-8")
    (box / "4.csv").write_text("year,location_id\n2023,D\n", encoding="utf-8")
    (box / "5.csv").write_text("")
    got = sources.read_interventions(spark, str(box), clean=False)
    assert sorted(map(tuple, got.select("location_id", "year", "note", "crop_yield_ton_per_ha").collect())) == [
        ("A", "2020", "S\u00e3o", "1.5"), ("B", "2021", "Jos\u00e9", "2.5"), ("C", "2022", "x", "3.5"), ("D", "2023", None, None)]
    rows = ["location_id,year,season,water_area_ha,water_body_count\nA,2020,winter,5,1\n",
            "location_id,year,season,water_body_count,water_area_ha\nB,2020,winter,1,5\n"]
    for i, text in enumerate(rows):
        (tmp_path / "obs").mkdir(exist_ok=True)
        (tmp_path / "obs" / f"{i}.csv").write_text(text)
    seen = sources.read_observations(spark, str(tmp_path / "obs")).collect()
    assert {(r.location_id, r.water_area_ha, r.water_body_count) for r in seen} == {("A", 5.0, 1), ("B", 5.0, 1)}


def test_headers_are_found_without_a_sort_of_the_lines(spark, tmp_path):
    for i, (head, row) in enumerate([("a,b", "1,2"), ("b,a", "1,2"), ("a,b", "3,4"), ("a,b", "é,5"), ("b,a", "")]):
        (tmp_path / f"{i}.csv").write_bytes((head + "\n" + f"{row}\n" * 50).encode("latin-1"))
    heads = tables._file_heads(spark, str(tmp_path), True)
    assert "Sort" not in heads._jdf.queryExecution().executedPlan().toString()
    assert heads.count() == 5 and heads.select("h0", "h1").distinct().count() == 2
    groups = tables._file_groups(spark, str(tmp_path), "UTF-8", tables.LATIN1)
    assert sorted(([n[-5] for n in names], known) for names, known in groups) == [
        (["0", "2"], "UTF-8"), (["1", "4"], "UTF-8"), (["3"], tables.LATIN1)]


def test_empty_interventions(spark, tmp_path):
    f = tmp_path / "empty.csv"
    f.write_text("location_id,year\n")
    with pytest.raises(ValueError, match="no records"):
        sources.read_interventions(spark, str(f))


def test_selection(spark, water):
    got = sources.select_observations(water, [" east ", "", "nowhere"], 2012, 2013, [" Winter", "MONSOON"])
    assert got.count() == 2
    assert sources.select_observations(water, ["east"], 2012, 2013, []).count() == 4
    for args in (([], 2020, 2021), (["V001"], 2022, 2021), (["V001"], 1800, 2021), (["V001"], 2020, 2021, ["x"]),
                 (["V001"], "2020", 2021), (["V001"], 2020, 9999)):
        with pytest.raises(ValueError):
            sources.select_observations(water, *args)
    assert sources.parse_locations(" a, ,b,") == ["a", "b"]
    with pytest.raises(ValueError):
        sources.parse_locations(" , ")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_written_tables_read_back(spark, water, water_rows, tmp_path, fmt):
    path = write_table(water, str(tmp_path), "water data!", fmt, keys=["location_id", "year", "season"])
    assert path.endswith(f"water_data_.{fmt}")
    reader = spark.read.schema(water.schema)
    back = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(water_rows)
    write_table(water.limit(2), str(tmp_path), "water data!", fmt)
    assert spark.read.format(fmt).option("header", True).load(path).count() == 2


def test_table_rewritten_from_itself(spark, water, tmp_path):
    name = ("panel", "parquet")
    path = write_table(water, str(tmp_path), *name)
    for _ in range(2):
        write_table(spark.read.parquet(path).filter("season = 'winter'"), str(tmp_path), *name)
        assert spark.read.parquet(path).count() == water.filter("season = 'winter'").count()


def test_failed_write_leaves_the_old_table(spark, water, tmp_path):
    path = write_table(water, str(tmp_path), "panel", "parquet")
    broken = spark.read.parquet(path).withColumn("year", F.when(F.col("year") > 2013, F.raise_error(F.lit("stop"))).otherwise(F.col("year")))
    with pytest.raises(Exception, match="stop"):
        write_table(broken, str(tmp_path), "panel", "parquet", allow_empty=True)
    assert spark.read.parquet(path).count() == water.count()
    assert [p.name for p in tmp_path.iterdir()] == ["panel.parquet"]


def test_documents_that_are_not_strict_json(spark):
    area = {"nan_text": '{"area_ha":"nan","count":1}', "nan": '{"area_ha":NaN,"count":1}',
            "twice": '{"area_ha":1,"area_ha":2.5,"count":1}', "large": '{"area_ha":1,"count":3000000000}',
            "large_text": '{"area_ha":1,"count":"3000000000"}', "word": '{"area_ha":"x","count":1}'}
    docs = spark.createDataFrame([(k, f'[{{"year":2020,"seasons":{{"winter":{v}}}}}]') for k, v in area.items()],
                                 "location_id string, document string")
    got = {r.location_id: (r.water_area_ha, r.water_body_count) for r in sources.flatten_timeseries(docs).collect()}
    assert got == {"nan_text": (None, 1), "nan": (None, 1), "twice": (2.5, 1), "large": (1.0, 3_000_000_000),
                   "large_text": (1.0, 3_000_000_000), "word": (0.0, 1)}
    assert {r.location_id for r in sources.load_observations(docs).collect()} == {"twice", "large", "large_text", "word"}
    assert sources.document_rejects(docs).isEmpty()


def test_writing_refuses(water, tmp_path):
    for args, kwargs in (((water.limit(0), str(tmp_path), "x"), {}), ((water, str(tmp_path), " "), {}),
                         ((water, str(tmp_path), "x"), {"fmt": "excel"})):
        with pytest.raises(ValueError):
            write_table(*args, **kwargs)
    assert clean_filename(" a b/c.d-e_f ") == "a_b_c_d-e_f"


def test_order_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    assert [r.k for r in ordered(df, ["k"]).collect()] == [1, 2, None]


def land(directory, name, body):
    directory.mkdir(exist_ok=True)
    (directory / name).write_text(json.dumps(body, indent=2))


def test_staged_workflow(spark, tmp_path):
    box, out = tmp_path / "landing", str(tmp_path / "out")
    for name in ("V001", "V002", "V003"):
        land(box, f"{name}.json", {"data": {"timeseries": [
            entry(y, winter={"area_ha": y - 2000, "count": 1}, summer={"area_ha": -1}) for y in (2019, 2020, 2021)]}})
    (tmp_path / "nrm.csv").write_text("location_id,year,pond_presence\nV001,2020,1\nV002,2020,0\n")
    water = workflow.fetch(spark, str(box), out, ["V001", "V002"], 2020, 2021)
    stored = spark.read.parquet(water)
    assert stored.count() == 4 and {r.season for r in stored.collect()} == {"winter"}
    plain = spark.read.parquet(workflow.merge(spark, stored, out, name="plain"))
    assert plain.filter("nrm_data_available").isEmpty()
    merged = workflow.merge(spark, stored, out, str(tmp_path / "nrm.csv"))
    match = spark.read.csv(f"{out}/merged_data_match.csv", header=True).first()
    assert match.matched_records == "2"
    assert spark.read.csv(f"{out}/merged_data_repeated_keys.csv", header=True).first().duplicate_rows == "0"
    assert spark.read.csv(f"{out}/water_data_cleaning.csv", header=True).first().area_out_of_range == "4"
    results = workflow.analyse(spark, merged, out)
    assert set(results) == {"trends", "seasonal_summary", "intervention_summary"}
    assert spark.read.parquet(results["trends"]).first().trend_slope_ha_per_year == 1.0
    written = workflow.report(spark, merged, out)
    metrics = spark.read.csv(written["summary_metrics"], header=True)
    assert metrics.filter("metric = 'Total Records'").first().value == "4"


def test_intake_continues_where_it_stopped(spark, tmp_path):
    box, target, progress = tmp_path / "landing", str(tmp_path / "t"), str(tmp_path / "p")
    land(box, "V001.json", [entry(winter={"area_ha": 1}, summer={"area_ha": 10001})])
    land(box, "V 2.json", [entry(winter={"area_ha": 2})])
    landing.ingest_available(spark, str(box), target, progress, max_files=1).awaitTermination()
    assert {r.location_id for r in spark.read.parquet(target).collect()} == {"V001", "V 2"}
    land(box, "V003.json", [entry(2021, winter={"area_ha": 3}), entry(2021, winter={"area_ha": 3})])
    landing.ingest_available(spark, str(box), target, progress).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 4 and cleaning.clean_observations(got).count() == 3
    assert got.filter(F.col("year") == 2021).count() == 2


def test_working_tables_are_deleted_and_kept_ones_stay(spark):
    with working_tables(spark) as keep:
        inner = stored(spark.range(5))
        with working_tables(spark) as keep_inner:
            deepest = stored(spark.range(3))
            middle = keep_inner(deepest.union(inner))
        result = keep(middle.filter("id < 2"))
    assert sorted(r.id for r in result.collect()) == [0, 0, 1, 1]
    for gone in (inner, deepest, middle):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            gone.count()


def test_typed_and_general_readers_agree(spark, monkeypatch):
    """Documents near the usual shape, each with one thing changed, read by either path."""
    info = '{"area_ha": 10.25, "count": 3, "quality": "fair"}'
    seasons = ['"winter": ' + info, '"monsoon": {}', '"harvest": ' + info, '"winter": {"count": 1}', '"summer": 5', '"summer": null',
               '"perennial": {"area_ha": 1e3, "count": -4, "other": [1, {"a": 2}]}', '"summer": {"area_ha": "7", "count": 2.9}',
               '"winter": {"area_ha": null, "quality": null}', '"winter": {"area_ha": NaN}', '"winter": {"quality": 5}',
               '"winter": {"quality": "a\\\\nb"}', '"winter": {"area_ha": 12345678901234567890.5, "count": 99999999999999999999}',
               '"winter": {"quality": {"x": 1}}', '"winter": []', '"winter": {"area_ha": true, "count": "4"}', '"winter": {"quality": ""}',
               '"winter": {"area_ha": 3}, "winter": {"area_ha": 4}', '"WINTER": ' + info]
    years = ["2020", "1899", '"2021"', "2020.0", "true", "null", "99999999999", "[2020]"]
    entries = [f'{{"year": 2020, "seasons": {{{s}}}}}' for s in seasons]
    entries += [f'{{"year": {y}, "seasons": {{"winter": {info}}}}}' for y in years]
    entries += ['{"seasons": {}}', '{"year": 2020}', '{"year": 2020, "seasons": []}', "5", "null", '{"year": 2020, "year": 2021, "seasons": {"winter": {}}}']
    bodies = [root % e for e in entries for root in ('{"timeseries": [%s]}', '{"data": {"timeseries": [%s]}}')]
    usual = f'{{"year": 2022, "seasons": {{"winter": {info}, "summer": {{}}}}}}'
    bodies += [f'{{"timeseries": [{e}, {usual}]}}' for e in entries]
    bodies += [f"[{usual}]", f'{{"data": [{usual}]}}', f'{{"timeseries": null, "data": {{"timeseries": [{usual}]}}}}', f'{{"timeseries": [{usual}]', "{}",
               f' {{"timeseries": [{usual}]}} ', f'{{"timeseries": [{usual}]}} x', f'{{"data": {{"timeseries": [{usual}]}}, "timeseries": []}}',
               f"{{'timeseries': [{usual}]}}", f'{{"timeseries": [{usual}], "timeseries": []}}', '{"timeseries": {"a": 1}}']
    df = spark.createDataFrame([(f"V{i}", b) for i, b in enumerate(bodies)], "location_id string, document string")
    typed = sorted(map(tuple, documents.flatten_timeseries(df).collect()), key=repr)
    monkeypatch.setattr(documents, "UNUSUAL", "")
    general = sorted(map(tuple, documents.flatten_timeseries(df).collect()), key=repr)
    assert repr(typed) == repr(general) and len(typed) > 60


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_documents_of_other_shapes_are_parsed_once(spark):
    season = '"winter":{"area_ha":%s,"count":%s}'
    texts = {
        "text_year": '{"timeseries":[{"year":"2001","seasons":{%s,"summer":5,"monsoon":null,"perennial":{}}}]}' % (season % (2.5, "7.9")),
        "fraction": '{"timeseries":[{"year":2001.5,"seasons":{%s}},{"year":2002,"seasons":{%s}}]}' % (season % (1, 1), season % ("true", '" 8 "')),
        "no_object": '{"timeseries":[5,{"year":2003,"seasons":{%s}}]}' % (season % ('"nan"', "-3")),
        "nulls": '[{"year":2004,"seasons":{"winter":{"area_ha":null,"count":null,"quality":null}}}]',
        "page": " \n<html>1</html>", "number": "5", "tag": '{"timeseries":[{"year":2005,"seasons":{%s}}],"note":"<b>"}' % (season % (1.0, 2)),
        "absent": None}
    df = spark.createDataFrame(list(texts.items()), "location_id string, document string")
    found = documents.flatten_timeseries(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert sorted(tuple(r) for r in found.collect()) == [
        ("fraction", 2002, "winter", 1.0, 8, "good"),
        ("no_object", 2003, "winter", None, 0, "good"),
        ("nulls", 2004, "winter", 0.0, 0, None),
        ("tag", 2005, "winter", 1.0, 2, "good"),
        ("text_year", 2001, "perennial", 0.0, 0, "good"),
        ("text_year", 2001, "winter", 2.5, 7, "good")]
    assert sorted(r.location_id for r in documents.document_rejects(df).filter("reason = 'not_json'").collect()) == ["absent", "page"]


def test_state_of_batches_is_the_state_of_all_rows(spark, tmp_path):
    rows = [(f"v{i % 5}", 1898 + i % 250 if i % 3 else 2000 + i % 9, ("winter", "summer")[i % 2], i * 1.5 if i % 11 else None) for i in range(600)]
    rows += [(None, 2000, "winter", 1.0), ("v1", None, "winter", None), ("x", None, "winter", 3.0), ("one", 2001, "summer", 4.0)]
    df = spark.createDataFrame(rows, "location_id string, year int, season string, water_area_ha double")
    want = rounded(trends.water_trends(df).drop("median_water_area_ha"))
    folder = str(tmp_path / "state")
    with pytest.raises(ValueError):
        state.read_state(spark, folder)
    batches = [df.filter(F.pmod(F.hash(*df.columns), F.lit(5)) == k) for k in range(5)]
    for number, batch in enumerate(batches):
        state.fold_batch(batch, number, folder)
        state.fold_batch(batch, number, folder)  # run again
        if number in (1, 3):
            state.compact_state(spark, folder)
            state.fold_batch(batch, number, folder)  # run again after it became part of a sum
    assert rounded(state.state_trends(state.read_state(spark, folder))) == want
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch-2", "batch-3", "batch-4", "sum-1", "sum-3"]
    state.compact_state(spark, folder)
    state.compact_state(spark, folder)
    assert rounded(state.state_trends(state.read_state(spark, folder))) == want
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch-4", "sum-3", "sum-4"]


def test_incomplete_folders_do_not_count(spark, tmp_path):
    df = spark.createDataFrame([("a", 2000, "winter", 1.0), ("a", 2002, "winter", 3.0)], "location_id string, year int, season string, water_area_ha double")
    folder = tmp_path / "state"
    state.fold_batch(df, 0, str(folder))
    want = rounded(state.state_coverage(state.read_state(spark, str(folder))))
    assert want == [("a", "winter", 2, 2, 2, 1.0)]
    for name in ("batch-1", "sum-0"):  # a writer that died left files without the mark of success
        state.fold_batch(df, 5, str(tmp_path / "other"))
        (tmp_path / "other" / "batch-5").rename(folder / name)
        (folder / name / "_SUCCESS").unlink()
    assert rounded(state.state_coverage(state.read_state(spark, str(folder)))) == want


def test_trends_of_a_landing_directory(spark, tmp_path):
    box, folder, progress = tmp_path / "landing", str(tmp_path / "state"), str(tmp_path / "p")
    land(box, "V001.json", [entry(2020, winter={"area_ha": 1}), entry(2021, winter={"area_ha": 3})])
    land(box, "V002.json", [entry(2020, winter={"area_ha": 5})])
    state.keep_trends(spark, str(box), folder, progress, max_files=1).awaitTermination()
    land(box, "V001b.json", [entry(2022, winter={"area_ha": 2})])
    state.keep_trends(spark, str(box), folder, progress).awaitTermination()
    got = {r.location_id: (r.data_points, r.trend_slope_ha_per_year) for r in state.state_trends(state.read_state(spark, folder)).collect()}
    assert got == {"V001": (2, 2.0), "V002": (1, 0.0), "V001b": (1, 0.0)}
