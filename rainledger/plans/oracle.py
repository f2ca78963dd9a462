"""The same queries as SQL for another engine, written from the definition of each operator.

Doubles are rounded like ``tidy`` in ``queries.py`` rounds them.
"""

from __future__ import annotations

SEASON = """CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter'
    WHEN month(l_shipdate) BETWEEN 3 AND 5 THEN 'summer'
    WHEN month(l_shipdate) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'perennial' END"""
PLACE = "concat('V', lpad(CAST(l_suppkey AS VARCHAR), 6, '0'))"
QUALITY = "CASE WHEN l_returnflag = 'R' THEN 'poor' ELSE 'good' END"

CTES = {
    "water_raw": f"""SELECT {PLACE} AS location_id, CAST(year(l_shipdate) AS INT) AS year, {SEASON} AS season,
        l_extendedprice / 9.0 AS water_area_ha, CAST(l_quantity AS BIGINT) AS water_body_count,
        {QUALITY} AS data_quality FROM lineitem""",
    "water": """SELECT DISTINCT * FROM water_raw
        WHERE year BETWEEN 1900 AND 2100 AND water_area_ha BETWEEN 0 AND 10000 AND water_body_count >= 0""",
    "water_text": f"""SELECT CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE {PLACE} END AS location_id,
        CASE l_orderkey % 50 WHEN 0 THEN '2020.5' WHEN 1 THEN 'abc' WHEN 2 THEN '1850'
            WHEN 3 THEN concat(year(l_shipdate), '.0') WHEN 4 THEN concat(' ', year(l_shipdate))
            ELSE CAST(year(l_shipdate) AS VARCHAR) END AS year,
        CASE WHEN l_orderkey % 47 = 0 THEN 'Monsoon' ELSE {SEASON} END AS season,
        CASE WHEN l_orderkey % 41 = 0 THEN '12d' WHEN l_orderkey % 43 = 0 THEN 'nan'
            WHEN l_orderkey % 53 = 0 THEN '-0.5' ELSE CAST(l_extendedprice / 9.0 AS VARCHAR) END AS water_area_ha,
        CASE WHEN l_orderkey % 37 = 0 THEN '-1' WHEN l_orderkey % 31 = 0 THEN NULL
            ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS water_body_count,
        {QUALITY} AS data_quality FROM lineitem""",
    "water_typed": """SELECT location_id, season, data_quality, year, water_area_ha, water_body_count,
        TRY_CAST(trim(year) AS DOUBLE) AS y,
        CASE WHEN isnan(TRY_CAST(water_area_ha AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(water_area_ha AS DOUBLE) END AS a,
        TRY_CAST(water_body_count AS DOUBLE) AS c FROM water_text""",
    "water_judged": """SELECT *, CASE WHEN y <> floor(y) THEN 'year_not_whole'
        WHEN y NOT BETWEEN 1900 AND 2100 THEN 'year_out_of_range'
        WHEN season IS NULL OR season NOT IN ('perennial', 'winter', 'monsoon', 'summer') THEN 'invalid_season'
        WHEN y IS NULL OR a IS NULL THEN 'missing_value'
        WHEN a NOT BETWEEN 0 AND 10000 THEN 'area_out_of_range'
        WHEN c IS NULL OR c < 0 THEN 'invalid_body_count' END AS reason FROM water_typed""",
    "nrm_raw": """SELECT CASE WHEN (s_suppkey + y.year) % 23 <> 3
            THEN concat('V', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) END AS location_id,
        CASE (s_suppkey + y.year) % 23 WHEN 0 THEN '2020.5' WHEN 1 THEN '1850' WHEN 2 THEN 'abc'
            ELSE CAST(y.year AS VARCHAR) END AS year,
        CASE s_suppkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' TRUE ' WHEN 3 THEN 'absent'
            WHEN 4 THEN 'maybe' WHEN 5 THEN NULL WHEN 6 THEN '1' ELSE '0' END AS pond_presence,
        CASE s_suppkey % 5 WHEN 0 THEN ' Pond ' WHEN 1 THEN 'check_dam' WHEN 2 THEN 'Terrace'
            WHEN 3 THEN 'none' END AS intervention_type,
        s_acctbal / 1000.0 AS crop_yield_ton_per_ha,
        CASE WHEN s_nationkey < 8 THEN 'low' WHEN s_nationkey < 16 THEN 'medium' ELSE 'high' END
            AS drought_sensitivity
        FROM supplier CROSS JOIN (VALUES (1996), (1997), (1998), (1999), (2000)) AS y(year)""",
    "nrm_judged": """SELECT *, CASE WHEN year = '2020.5' THEN 'year_not_whole' WHEN year = '1850' THEN 'year_out_of_range'
        WHEN year = 'abc' OR location_id IS NULL THEN 'missing_value' END AS reason FROM nrm_raw""",
    "nrm": """SELECT DISTINCT location_id, CAST(year AS INT) AS year,
        CASE WHEN lower(trim(pond_presence)) IN ('yes', 'y', 'true', 't', '1', 'present') THEN 1 ELSE 0 END
            AS pond_presence,
        lower(trim(intervention_type)) AS intervention_type, crop_yield_ton_per_ha, drought_sensitivity
        FROM nrm_judged WHERE reason IS NULL""",
    "merged": """SELECT w.*, n.pond_presence, n.intervention_type, n.crop_yield_ton_per_ha, n.drought_sensitivity,
        n.location_id IS NOT NULL AS nrm_data_available
        FROM water w LEFT JOIN nrm n ON w.location_id = n.location_id AND w.year = n.year""",
    "grain": """SELECT location_id, year, season, avg(water_area_ha) AS water_area_ha,
        CAST(sum(water_body_count) AS BIGINT) AS water_body_count FROM water GROUP BY location_id, year, season""",
    "docs": f"""SELECT {PLACE} AS location_id, CAST(year(l_shipdate) AS INT) AS year, {SEASON} AS season,
        l_orderkey % 12 AS k, l_extendedprice / 9.0 AS area, CAST(l_quantity AS BIGINT) AS n FROM lineitem""",
    "flat": """SELECT location_id, year, season,
        CASE WHEN k = 3 THEN 0.0 WHEN k IN (8, 10) THEN NULL ELSE area END AS water_area_ha,
        CASE WHEN k IN (3, 5) THEN 0 WHEN k = 11 THEN CAST(concat('30000000', n) AS BIGINT) ELSE n END AS water_body_count,
        CASE k WHEN 0 THEN 'poor' WHEN 2 THEN NULL ELSE 'good' END AS data_quality
        FROM docs WHERE k IN (0, 1, 2, 3, 5, 8, 9, 10, 11)""",
    "slopes": """SELECT location_id, season, count(*) AS n, min(year) < max(year) AS spread,
        CASE WHEN min(year) < max(year) THEN regr_slope(water_area_ha, year) ELSE 0.0 END AS slope FROM water GROUP BY location_id, season""",
    "seasonal": """SELECT location_id, season, count(*) AS n, avg(water_area_ha) AS m,
        stddev_samp(water_area_ha) AS s, count(DISTINCT year) AS y, max(year) - min(year) AS span
        FROM water GROUP BY location_id, season""",
    "sparse": f"""SELECT CASE WHEN o_orderkey % 19 <> 0 THEN concat('C', lpad(CAST(o_custkey AS VARCHAR), 6, '0')) END
            AS location_id, CAST(year(o_orderdate) AS INT) AS year, {SEASON.replace('l_shipdate', 'o_orderdate')} AS season,
        CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice / 1000.0 * 40 WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000.0 END
            AS water_area_ha, CAST(o_orderkey % 20 AS BIGINT) AS water_body_count FROM orders""",
    "sparse_valid": "SELECT * FROM sparse WHERE location_id IS NOT NULL AND water_area_ha IS NOT NULL",
    "top3": """SELECT location_id FROM water GROUP BY location_id
        ORDER BY count(*) DESC, location_id LIMIT 3""",
    "top5": """SELECT * FROM water WHERE location_id IN (SELECT location_id FROM water GROUP BY location_id
        ORDER BY count(*) DESC, location_id LIMIT 5)""",
    "text_flag": """SELECT * REPLACE (CASE WHEN pond_presence IS NULL THEN NULL WHEN year % 7 < 3 THEN 1
        WHEN year % 7 < 6 THEN 0 END AS pond_presence) FROM merged""",
    "top3_grain": "SELECT location_id FROM grain GROUP BY location_id ORDER BY count(*) DESC, location_id LIMIT 3",
    "per_location": """SELECT location_id, count(*) AS records, min(year) AS first_year, max(year) AS last_year,
        avg(water_area_ha) AS m, min(water_area_ha) AS lo, max(water_area_ha) AS hi, avg(water_body_count) AS b
        FROM water GROUP BY location_id""",
}


def r(expr: str, name: str) -> str:
    """A rounded double column."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 4) + 0.0 AS {name}"


def same(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


OBS = f"location_id, year, season, {same('water_area_ha')}, water_body_count, data_quality"
NRM = f"pond_presence, intervention_type, {same('crop_yield_ton_per_ha')}, drought_sensitivity"
CLEAN_TEXT = f"""SELECT DISTINCT location_id, CAST(y AS INT) AS year, season, {r('a', 'water_area_ha')},
    CAST(trunc(c) AS BIGINT) AS water_body_count, data_quality FROM water_judged WHERE reason IS NULL"""
REASONS = ("year_not_whole", "year_out_of_range", "invalid_season", "missing_value", "area_out_of_range",
           "invalid_body_count")


def trend(keys: str) -> str:
    return f"""SELECT {keys}, {r('avg(water_area_ha)', 'mean_water_area_ha')},
        {r('stddev_samp(water_area_ha)', 'std_water_area_ha')}, {r('min(water_area_ha)', 'min_water_area_ha')},
        {r('max(water_area_ha)', 'max_water_area_ha')}, {r('median(water_area_ha)', 'median_water_area_ha')},
        {r('coalesce(regr_slope(water_area_ha, year), 0)', 'trend_slope_ha_per_year')},
        CASE WHEN min(year) = max(year) THEN 'insufficient_data' WHEN count(*) >= 3 THEN 'good'
            WHEN count(*) = 2 THEN 'minimal_data' ELSE 'insufficient_data' END AS trend_quality,
        count(*) AS data_points, min(year) AS start_year, max(year) AS end_year,
        max(year) - min(year) AS year_span,
        {r('CASE WHEN avg(water_area_ha) > 0 THEN stddev_samp(water_area_ha) / avg(water_area_ha) ELSE 0 END',
           'coefficient_of_variation')},
        count(*) AS total_observations FROM water GROUP BY {keys}"""


AREA_STATS = f"""{r('avg(water_area_ha)', 'water_area_ha_mean')},
    {r('stddev_samp(water_area_ha)', 'water_area_ha_std')}, {r('min(water_area_ha)', 'water_area_ha_min')},
    {r('max(water_area_ha)', 'water_area_ha_max')}, count(water_area_ha) AS water_area_ha_count,
    {r('median(water_area_ha)', 'water_area_ha_median')}"""
COUNT_STATS = f"""{r('avg(water_body_count)', 'water_body_count_mean')},
    {r('stddev_samp(water_body_count)', 'water_body_count_std')}, min(water_body_count) AS water_body_count_min,
    max(water_body_count) AS water_body_count_max, CAST(sum(water_body_count) AS BIGINT) AS water_body_count_sum"""
CV = r("coalesce(stddev_samp(water_area_ha) / nullif(avg(water_area_ha), 0), 0)", "water_area_ha_cv")


def intervention(rows: str) -> str:
    base = f"(SELECT avg(water_area_ha) FROM {rows} WHERE coalesce(pond_presence, 0) = 0)"
    both = f"(SELECT count(DISTINCT coalesce(pond_presence, 0)) FROM {rows}) = 2"
    flag = "coalesce(pond_presence, 0)"
    return f"""SELECT {flag} AS pond_presence, {AREA_STATS}, count(*) AS water_area_ha_valid_count, {COUNT_STATS},
        count(DISTINCT location_id) AS location_id_nunique,
        CASE {flag} WHEN 0 THEN 'No Intervention' ELSE 'With Intervention' END AS intervention_type, {CV},
        {r(f"CASE WHEN {both} AND {base} > 0 THEN CASE {flag} WHEN 0 THEN 0.0 ELSE (avg(water_area_ha) - {base}) / {base} * 100 END END", 'water_area_increase_pct')}
        FROM {rows} GROUP BY {flag}"""


def seasonal(level: str, rows: str) -> str:
    span = "(max(year) - min(year))"
    complete = f"CASE WHEN {span} = 0 THEN CAST('inf' AS DOUBLE) ELSE count(DISTINCT year) / {span} END"
    return f"""SELECT {level}, season, {AREA_STATS}, min(year) AS year_min, max(year) AS year_max,
        count(location_id) AS location_id_count, {COUNT_STATS}, count(DISTINCT year) AS year_nunique,
        {span} AS year_span, {CV}, {r(complete, 'data_completeness')},
        CASE WHEN {complete} < 0.5 THEN 'gaps_in_data'
            WHEN stddev_samp(water_area_ha) / avg(water_area_ha) > 1 THEN 'high_variability'
            WHEN count(*) < 3 THEN 'limited_data' ELSE 'good' END AS data_quality
        FROM {rows} GROUP BY {level}, season"""


def report(rows: str, reasons: tuple[str, ...], columns: str) -> str:
    counts = ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in reasons)
    valid = f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {rows} WHERE reason IS NULL))"
    return f"""WITH counted AS (SELECT count(*) AS original_records, {counts},
            count(*) FILTER (reason IS NULL) - {valid} AS duplicate, {valid} AS final_records FROM {rows})
        SELECT *, original_records - final_records AS records_removed,
            {r('(original_records - final_records) * 100.0 / original_records', 'removal_rate_pct')},
            (original_records - final_records) * 100.0 / original_records > 50 AS high_removal FROM counted"""


def histogram(value: str, by: str | None, rows: str = "water") -> str:
    key = f"{by}, " if by else ""
    low, high = f"(SELECT min({value}) FROM {rows})", f"(SELECT max({value}) FROM {rows})"
    width = f"(CAST({high} - {low} AS DOUBLE) / 30)"
    return f"""WITH b AS (SELECT {key}CAST(least(floor(({value} - {low}) / CAST({high} - {low} AS DOUBLE) * 30), 29) AS INT)
            AS bin FROM {rows})
        SELECT {key}bin, {r(f'{low} + bin * {width}', 'bin_start')}, {r(f'{low} + (bin + 1) * {width}', 'bin_end')},
            count(*) AS records FROM b GROUP BY {key}bin"""


def round_histogram(value: str, by: str | None, half: float, least: float) -> str:
    """``half``: how far edges lie below multiples of the step, which is ``least`` or more."""
    key = f"{by}, " if by else ""
    return f"""WITH e AS (SELECT CAST(min({value}) AS DOUBLE) AS low, CAST(max({value}) AS DOUBLE) AS high FROM water),
        s AS (SELECT step, floor(low / step) * step - {half} AS start FROM e, (SELECT greatest(m * pow(10.0, k), {least}) AS step
            FROM (VALUES (1), (2), (5)) AS a(m), range(-6, 9) AS b(k)) AS t
            WHERE floor((high - (floor(low / step) * step - {half})) / step) < 30 ORDER BY step LIMIT 1),
        b AS (SELECT {key}CAST(floor(({value} - start) / step) AS INT) AS bin, start, step FROM water, s)
        SELECT {key}bin, {r('any_value(start) + bin * any_value(step)', 'bin_start')},
            {r('any_value(start) + (bin + 1) * any_value(step)', 'bin_end')}, count(*) AS records FROM b GROUP BY {key}bin"""


def box(where: str) -> str:
    return f"""WITH w AS (SELECT * FROM water WHERE {where}),
        q AS (SELECT season, count(*) AS records, quantile_cont(water_area_ha, 0.25) AS q1,
            median(water_area_ha) AS median, quantile_cont(water_area_ha, 0.75) AS q3 FROM w GROUP BY season),
        f AS (SELECT w.season, water_area_ha AS v, water_area_ha BETWEEN q1 - 1.5 * (q3 - q1)
            AND q3 + 1.5 * (q3 - q1) AS inside FROM w JOIN q ON w.season = q.season)
        SELECT season, any_value(records) AS records, {r('any_value(q1)', 'q1')},
            {r('any_value(median)', 'median')}, {r('any_value(q3)', 'q3')},
            {r('min(v) FILTER (inside)', 'whisker_low')}, {r('max(v) FILTER (inside)', 'whisker_high')},
            count(*) FILTER (NOT inside) AS outliers FROM f JOIN q USING (season) GROUP BY season"""


def pivot(keys: str, rows: str, seasons: tuple[str, ...], where: str = "true", fill: bool = True) -> str:
    cells = ", ".join(
        r(f"coalesce(avg(water_area_ha) FILTER (season = '{s}'), 0)", s) for s in seasons)
    return f"SELECT {keys}, {cells} FROM {rows} WHERE {where} GROUP BY {keys}"


SEASONS = ("perennial", "winter", "monsoon", "summer")
TEXT_METRICS = """SELECT * FROM (VALUES
    ('Total Records', (SELECT CAST(count(*) AS VARCHAR) FROM merged)),
    ('Unique Locations', (SELECT CAST(count(DISTINCT location_id) AS VARCHAR) FROM merged)),
    ('Year Range', (SELECT concat(min(year), '-', max(year)) FROM merged)),
    ('Mean Water Area (ha)', (SELECT printf('%.2f', avg(water_area_ha)) FROM merged)),
    ('Max Water Area (ha)', (SELECT printf('%.2f', max(water_area_ha)) FROM merged)),
    ('Min Water Area (ha)', (SELECT printf('%.2f', min(water_area_ha)) FROM merged)),
    ('Records with Pond', (SELECT CAST(count(*) FILTER (pond_presence = 1) AS VARCHAR) FROM merged)),
    ('Records without Pond', (SELECT CAST(count(*) - count(*) FILTER (pond_presence = 1) AS VARCHAR) FROM merged))
    ) AS t(metric, value)"""
QUICK = """SELECT * FROM (VALUES
    ('Total Locations', (SELECT CAST(count(DISTINCT location_id) AS VARCHAR) FROM merged)),
    ('Year Range', (SELECT concat(min(year), '-', max(year)) FROM merged)),
    ('Total Records', (SELECT format('{:,}', count(*)) FROM merged)),
    ('Avg Water Area', (SELECT printf('%.1f ha', avg(water_area_ha)) FROM merged)),
    ('Max Water Area', (SELECT printf('%.1f ha', max(water_area_ha)) FROM merged)),
    ('Locations with Ponds',
        (SELECT CAST(count(DISTINCT location_id) FILTER (pond_presence = 1) AS VARCHAR) FROM merged)),
    ('Locations without Ponds',
        (SELECT CAST(count(DISTINCT location_id) FILTER (pond_presence = 0) AS VARCHAR) FROM merged))
    ) AS t(metric, value)"""
INSIGHTS = f"""WITH y AS (SELECT year, avg(water_area_ha) AS m FROM merged GROUP BY year),
    s AS (SELECT season, avg(water_area_ha) AS m FROM merged GROUP BY season),
    t AS (SELECT regr_slope(m, year) AS slope FROM y),
    p AS (SELECT avg(water_area_ha) FILTER (pond_presence = 1) AS w,
        avg(water_area_ha) FILTER (pond_presence = 0) AS o,
        100.0 * count(*) FILTER (data_quality = 'good') / count(*) AS q FROM merged)
    SELECT insight, level, {r('v', 'value')} FROM (
    SELECT 'trend' AS insight, CASE WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'declining'
        ELSE 'stable' END AS level, slope AS v FROM t
    UNION ALL (SELECT 'highest_season', season, m FROM s ORDER BY m DESC, season LIMIT 1)
    UNION ALL (SELECT 'lowest_season', season, m FROM s ORDER BY m, season LIMIT 1)
    UNION ALL SELECT 'pond_effect', CASE WHEN w > 1.2 * o THEN 'higher' WHEN w < 0.8 * o THEN 'lower'
        ELSE 'similar' END, w / o FROM p
    UNION ALL SELECT 'data_quality', CASE WHEN q > 90 THEN 'high' WHEN q > 70 THEN 'moderate' ELSE 'low' END, q
        FROM p)"""
DESCRIBED = ("year", "water_area_ha", "water_body_count", "pond_presence", "crop_yield_ton_per_ha")
DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')},
    {r(f'min({c})', '"min"')}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')},
    {r(f'quantile_cont({c}, 0.75)', 'p75')}, {r(f'max({c})', '"max"')} FROM merged""" for c in DESCRIBED)
UNIT = "concat('V', lpad(CAST(s_suppkey AS VARCHAR), 6, '0'))"

ORACLE: dict[str, str] = {
    "src_water_csv": CLEAN_TEXT,
    "src_nrm_csv": f"""SELECT location_id, year, pond_presence, intervention_type,
        {same('crop_yield_ton_per_ha')}, drought_sensitivity FROM nrm""",
    "src_encoding_fallback": """SELECT concat('Sã', s_suppkey) AS location_id, CAST(1999 AS INT) AS year,
        s_name AS note FROM supplier""",
    "json_flatten": f"SELECT {OBS} FROM flat",
    "json_envelope_rejects": """SELECT reason, CAST(position AS INT) AS position, count(*) AS records FROM (
        SELECT CASE k WHEN 4 THEN 'invalid_year' ELSE 'not_json' END AS reason,
            CASE k WHEN 4 THEN 0 END AS position FROM docs WHERE k IN (4, 6)
        UNION ALL SELECT 'entry_not_object', 0 FROM docs WHERE k = 7
        UNION ALL SELECT 'entry_without_year', 1 FROM docs WHERE k = 7
        UNION ALL SELECT 'invalid_year', 0 FROM docs WHERE k = 10) GROUP BY ALL""",
    "json_season_rejects": """SELECT season, reason, count(*) AS records FROM (
        SELECT season, CASE k WHEN 3 THEN 'invalid_count' WHEN 5 THEN 'negative_count' WHEN 7 THEN 'info_not_object'
            ELSE 'missing_area' END AS reason FROM docs WHERE k IN (3, 7, 8, 10) OR k = 5 AND area <= 10000
        UNION ALL SELECT season, 'area_out_of_range' FROM docs WHERE k IN (0, 1, 2, 5, 9, 11) AND area > 10000
        UNION ALL SELECT 'winter ', 'unknown_season' FROM docs WHERE k = 1
        UNION ALL SELECT 'autumn', 'unknown_season' FROM docs WHERE k = 5) GROUP BY ALL""",
    "load_report": """SELECT location_id, count(*) AS documents, coalesce(any_value(kept), 0) AS observations,
        CASE WHEN any_value(kept) > 0 THEN 'loaded' ELSE 'empty' END AS status FROM docs LEFT JOIN (
        SELECT location_id, count(*) AS kept FROM (SELECT DISTINCT location_id, year, season, water_area_ha, water_body_count,
            data_quality FROM flat WHERE water_area_ha BETWEEN 0 AND 10000) GROUP BY location_id) USING (location_id)
        GROUP BY location_id""",
    "load_documents": f"SELECT DISTINCT {OBS} FROM flat WHERE water_area_ha BETWEEN 0 AND 10000",
    "spatial_units_filter": f"""SELECT {UNIT} AS id, s_name AS name, 'village' AS type, 'State 3' AS state,
        CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_nationkey = 3""",
    "elevation_cells": f"""SELECT concat('P', p_partkey) AS location_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col,
        {r('e', 'elevation')} FROM (
        SELECT p_partkey, 0 AS r, 0 AS c, p_retailprice AS e FROM part
        UNION ALL SELECT p_partkey, 0, 1, p_size FROM part UNION ALL SELECT p_partkey, 0, 2, 0 FROM part
        UNION ALL SELECT p_partkey, 1, 0, p_size FROM part UNION ALL SELECT p_partkey, 1, 1, NULL FROM part
        UNION ALL SELECT p_partkey, 1, 2, p_retailprice FROM part) WHERE p_partkey % 3 <> 0""",
    "concat_locations": f"""SELECT {OBS} FROM water UNION ALL SELECT location_id, year, season,
        {same('water_area_ha')}, water_body_count, NULL FROM grain""",
    "select_observations": f"""SELECT {OBS} FROM water WHERE location_id IN ('V000001', 'V000002', 'V000007')
        AND year BETWEEN 1996 AND 1998 AND season IN ('monsoon', 'winter')""",
    "sink_roundtrip": f"SELECT location_id, year, season, {same('water_area_ha')}, water_body_count FROM grain",
    "sink_versions": f"SELECT location_id, year, season, {same('water_area_ha')}, water_body_count FROM grain",
    "clean_water": CLEAN_TEXT,
    "clean_report": report("(SELECT * FROM water_judged UNION ALL SELECT * FROM water_judged)", REASONS,
                           "location_id, y, season, a, c, data_quality"),
    "rejected_rows": """SELECT location_id, year, season, water_area_ha, water_body_count, data_quality, reason
        FROM water_judged WHERE reason IS NOT NULL""",
    "clean_nrm": f"SELECT location_id, year, {NRM} FROM nrm",
    "clean_nrm_report": report(
        "(SELECT * FROM nrm_judged UNION ALL SELECT * FROM nrm_judged)",
        ("year_not_whole", "year_out_of_range", "missing_value"),
        "location_id, year, pond_presence, intervention_type, crop_yield_ton_per_ha, drought_sensitivity"),
    "normalize_columns": f"SELECT location_id, year, {NRM} FROM nrm_raw",
    "normalize_flag": """SELECT pond_presence AS raw, CAST(CASE WHEN pond_presence IN ('Yes', ' TRUE ', '1') THEN 1
        ELSE 0 END AS INT) AS flag, count(*) AS records FROM nrm_raw GROUP BY ALL""",
    "unknown_categories": """SELECT intervention_type, count(*) AS records FROM nrm
        WHERE intervention_type NOT IN ('pond', 'check_dam', 'contour_bund', 'other', 'none', '') GROUP BY 1""",
    "coerce_numeric": f"""SELECT {r('y', 'year')}, count(*) AS records, count(a) AS numbers, {r('max(a)', 'largest')}
        FROM water_typed GROUP BY y""",
    "split_list": """SELECT item, count(*) AS records FROM (SELECT s_name AS item FROM supplier
        UNION ALL SELECT concat('n', s_nationkey) FROM supplier) GROUP BY item""",
    "distinct_rows": "SELECT DISTINCT location_id, year, season FROM water_raw",
    "merge_left": f"SELECT {OBS}, {NRM}, nrm_data_available FROM merged",
    "merge_prepared": f"SELECT {OBS}, {NRM}, nrm_data_available FROM merged",
    "merge_none": f"SELECT {OBS}, false AS nrm_data_available FROM water",
    "merge_report": f"""SELECT count(*) AS total_records, count(*) FILTER (nrm_data_available) AS matched_records,
        count(*) FILTER (NOT nrm_data_available) AS unmatched_records,
        {r('100.0 * count(*) FILTER (nrm_data_available) / count(*)', 'match_rate_pct')},
        count(*) FILTER (nrm_data_available) < 0.5 * count(*) AS low_match FROM merged""",
    "merge_fanout": """SELECT w.season, n.location_id IS NOT NULL AS nrm_data_available,
        CASE WHEN n.location_id IS NOT NULL THEN 'survey' END AS data_quality_nrm, count(*) AS records
        FROM water w LEFT JOIN (SELECT * FROM nrm UNION ALL SELECT * FROM nrm) n
        ON w.location_id = n.location_id AND w.year = n.year GROUP BY ALL""",
    "duplicate_keys": """SELECT count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
        SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)""",
    "trend_by_location_season": trend("location_id, season"),
    "distinct_locations_rollup": """SELECT season, year, CAST(2 - grouping(season) - grouping(year) AS INT) AS level,
        count(DISTINCT location_id) AS locations FROM water GROUP BY ROLLUP (season, year)""",
    "trend_incremental": "SELECT * EXCLUDE (median_water_area_ha) FROM (" + trend("location_id, season") + ")",
    "coverage_incremental": f"""SELECT location_id, season, count(*) AS records, count(DISTINCT year) AS distinct_years,
        max(year) - min(year) AS year_span, {r("CASE WHEN max(year) = min(year) THEN 'infinity'::DOUBLE ELSE count(DISTINCT year) / (max(year) - min(year)) END", 'data_completeness')}
        FROM water GROUP BY location_id, season""",
    "trend_by_season": trend("season"),
    "intervention_summary": intervention("merged"),
    "intervention_summary_matched": intervention("(SELECT * FROM merged WHERE pond_presence IS NOT NULL)"),
    "seasonal_summary": seasonal("location_id", "water"),
    "seasonal_summary_sparse": seasonal("location_id", "sparse_valid"),
    "seasonal_quality_sparse": f"""SELECT data_quality, count(*) AS records
        FROM ({seasonal('location_id', 'sparse_valid')}) GROUP BY data_quality""",
    "trend_quality_sparse": """SELECT trend_quality, count(*) AS records FROM (
        SELECT CASE WHEN min(year) = max(year) THEN 'insufficient_data' WHEN count(*) >= 3 THEN 'good'
            WHEN count(*) = 2 THEN 'minimal_data' ELSE 'insufficient_data' END AS trend_quality
        FROM sparse_valid GROUP BY location_id, season) GROUP BY trend_quality""",
    "seasonal_summary_by_region": seasonal("region", """(SELECT w.*, p.region FROM water w LEFT JOIN (
        SELECT concat('V', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS location_id, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) p
        ON w.location_id = p.location_id WHERE p.region IS NOT NULL)"""),
    "summary_metrics": TEXT_METRICS,
    "quick_stats": QUICK,
    "key_insights": INSIGHTS,
    "fetch_summary": f"""SELECT count(DISTINCT location_id) AS locations, min(year) AS first_year,
        max(year) AS last_year, string_agg(DISTINCT season, ', ' ORDER BY season) AS seasons,
        {r('min(water_area_ha)', 'min_water_area_ha')}, {r('max(water_area_ha)', 'max_water_area_ha')} FROM water""",
    "value_distribution": """SELECT column_name, value, count(*) AS records FROM (
        SELECT 'trend_quality' AS column_name, CASE WHEN NOT spread THEN 'insufficient_data'
            WHEN n >= 3 THEN 'good' WHEN n = 2 THEN 'minimal_data' ELSE 'insufficient_data' END AS value FROM slopes
        UNION ALL SELECT 'pond_presence', CAST(pond_presence AS VARCHAR) FROM nrm
        UNION ALL SELECT 'intervention_type', intervention_type FROM nrm)
        WHERE value IS NOT NULL GROUP BY ALL""",
    "seasonal_quality_distribution": """SELECT CASE WHEN span > 0 AND y / span < 0.5 THEN 'gaps_in_data'
        WHEN s / m > 1 THEN 'high_variability' WHEN n < 3 THEN 'limited_data' ELSE 'good' END AS data_quality,
        count(*) AS records FROM seasonal GROUP BY 1""",
    "trend_summary": f"""SELECT count(*) AS groups_processed,
        count(*) FILTER (spread AND n >= 2) AS successful_groups,
        {r('100.0 * count(*) FILTER (spread AND n >= 2) / count(*)', 'success_rate_pct')},
        {r('avg(slope)', 'mean_slope_ha_per_year')} FROM slopes""",
    "trend_by_intervention": f"""SELECT pond_presence, count(*) AS "groups", {r('avg(s)', 'mean_slope_ha_per_year')} FROM (
        SELECT pond_presence, CASE WHEN min(year) < max(year) THEN regr_slope(water_area_ha, year) ELSE 0.0 END AS s FROM merged
        WHERE pond_presence IS NOT NULL GROUP BY pond_presence, location_id, season) GROUP BY pond_presence""",
    "correlation": " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 'correlation')} FROM merged"
        for a in ("pond_presence", "water_area_ha") for b in ("pond_presence", "water_area_ha")),
    "describe_numeric": DESCRIBE,
    "location_summaries": f"""SELECT location_id, records, first_year, last_year, {r('m', 'water_area_ha_mean')},
        {r('lo', 'water_area_ha_min')}, {r('hi', 'water_area_ha_max')}, {r('b', 'water_body_count_mean')}
        FROM per_location""",
    "aggregated_metrics": f"""SELECT count(*) AS locations, CAST(sum(records) AS BIGINT) AS records,
        min(first_year) AS first_year, max(last_year) AS last_year,
        {r('avg(m)', 'water_area_ha_mean_of_locations')}, {r('min(lo)', 'water_area_ha_min')},
        {r('max(hi)', 'water_area_ha_max')} FROM per_location""",
    "yoy_change": f"""SELECT location_id, year, {r('m', 'mean_water_area_ha')}, {r('m - p', 'change_ha')},
        {r('CASE WHEN p > 0 THEN (m - p) / p * 100 END', 'change_pct')} FROM (
        SELECT location_id, year, m, lag(m) OVER (PARTITION BY location_id ORDER BY year) AS p FROM (
        SELECT location_id, year, avg(water_area_ha) AS m FROM water GROUP BY location_id, year))""",
    "seasonal_pivot": pivot("year", "water", SEASONS),
    "seasonal_pivot_location": pivot("year", "grain", SEASONS, "location_id = 'V000001'"),
    "comparison_series": f"""SELECT year, CASE pond_presence WHEN 0 THEN 'Without Intervention'
        ELSE 'With Intervention' END AS pond_presence, {r('avg(water_area_ha)', 'water_area_ha')}
        FROM merged m WHERE m.pond_presence IS NOT NULL GROUP BY year, m.pond_presence""",
    "comparison_text_flag": f"""SELECT year, CASE t.pond_presence WHEN 0 THEN 'Without Intervention'
        WHEN 1 THEN 'With Intervention' END AS pond_presence, {r('avg(water_area_ha)', 'water_area_ha')}
        FROM text_flag t WHERE t.pond_presence IS NOT NULL GROUP BY year, t.pond_presence""",
    "trend_text_flag": f"""SELECT pond_presence, count(*) AS "groups", {r('avg(s)', 'mean_slope_ha_per_year')} FROM (
        SELECT pond_presence, CASE WHEN min(year) < max(year) THEN regr_slope(water_area_ha, year) ELSE 0.0 END AS s FROM text_flag
        WHERE pond_presence IS NOT NULL GROUP BY pond_presence, location_id, season) GROUP BY pond_presence""",
    "histogram_by_season": histogram("water_body_count", "season"),
    "histogram_round_by_season": round_histogram("water_body_count", "season", 0.5, 1.0),
    "area_histogram_round": round_histogram("water_area_ha", None, 0.0, 0.0),
    "impact_scatter_sample": f"""SELECT location_id, year, {same('water_area_ha', 'crop_yield_ton_per_ha')}, intervention_status FROM (
        SELECT *, CASE pond_presence WHEN 0 THEN 'Without Intervention' WHEN 1 THEN 'With Intervention' END AS intervention_status
        FROM merged) QUALIFY row_number() OVER (PARTITION BY intervention_status ORDER BY md5(concat_ws('|', location_id, year,
            CAST(floor(water_area_ha * 10000) AS BIGINT), coalesce(CAST(CAST(floor(crop_yield_ton_per_ha * 10000) AS BIGINT) AS VARCHAR), ''))),
            location_id, year, water_area_ha, crop_yield_ton_per_ha) <= 50""",
    "impact_grid": f"""WITH p AS (SELECT CASE pond_presence WHEN 0 THEN 'Without Intervention' WHEN 1 THEN 'With Intervention' END
            AS intervention_status, water_area_ha AS x, crop_yield_ton_per_ha AS y FROM merged WHERE crop_yield_ton_per_ha IS NOT NULL),
        e AS (SELECT min(x) AS lx, (max(x) - min(x)) / 40 AS wx, min(y) AS ly, (max(y) - min(y)) / 40 AS wy FROM p),
        c AS (SELECT intervention_status, CAST(least(floor((x - lx) / wx), 39) AS INT) AS x_cell,
            CAST(least(floor((y - ly) / wy), 39) AS INT) AS y_cell, e.* FROM p, e)
        SELECT intervention_status, x_cell, y_cell, {r('any_value(lx) + x_cell * any_value(wx)', 'x_start')},
            {r('any_value(ly) + y_cell * any_value(wy)', 'y_start')}, count(*) AS records FROM c GROUP BY intervention_status, x_cell, y_cell""",
    "capitalize": """SELECT season, upper(season[1]) || lower(season[2:]) AS label, count(*) AS records FROM water GROUP BY season""",
    "heatmap_pivot": "SELECT location_id, " + ", ".join(
        r(f"avg(water_area_ha) FILTER (year = {y})", f'"{y}"') for y in range(1995, 2002))
        + " FROM water GROUP BY location_id",
    "heatmap_long": f"""SELECT location_id, year, {r('avg(water_body_count)', 'water_body_count')}
        FROM water GROUP BY location_id, year""",
    "box_stats": box("year BETWEEN 1996 AND 2000"),
    "box_stats_all_years": box("true"),
    "impact_scatter": f"""SELECT location_id, year, {same('water_area_ha', 'crop_yield_ton_per_ha')},
        CASE pond_presence WHEN 0 THEN 'Without Intervention' WHEN 1 THEN 'With Intervention' END
            AS intervention_status FROM merged""",
    "top_locations": """SELECT location_id, count(*) AS records FROM water GROUP BY location_id
        ORDER BY records DESC, location_id LIMIT 5""",
    "dashboard_locations": f"""SELECT {OBS} FROM water WHERE location_id IN (SELECT location_id FROM water
        GROUP BY location_id ORDER BY count(*) DESC, location_id LIMIT 5)""",
    "dashboard_seasonal": pivot("location_id, year", "grain", ("perennial", "winter", "monsoon"),
                                "location_id IN (SELECT location_id FROM top3_grain)"),
    "dashboard_body_count": f"""SELECT location_id, year, {r('avg(water_body_count)', 'water_body_count')}
        FROM water WHERE location_id IN (SELECT location_id FROM top3) GROUP BY location_id, year""",
    "dashboard_yearly_area": f"""SELECT year, location_id, {r('avg(water_area_ha)', 'water_area_ha')}
        FROM water WHERE location_id IN (SELECT location_id FROM top3) GROUP BY location_id, year""",
    "area_histogram": histogram("water_area_ha", None),
    "dashboard_area_histogram": histogram("water_area_ha", None, "top5"),
    "yearly_mean": f"SELECT year, {r('avg(water_area_ha)', 'water_area_ha')} FROM water GROUP BY year",
    "bubble_radius": f"""SELECT location_id, year, season, {same('water_area_ha')},
        {r('sqrt(water_area_ha) / 10', 'radius')} FROM (SELECT * FROM water
        ORDER BY location_id, year, season, water_area_ha, water_body_count LIMIT 100)""",
    "head_n": f"""SELECT {OBS} FROM (SELECT * FROM water
        ORDER BY location_id, year, season, water_area_ha, water_body_count LIMIT 5)""",
    "ordered": f"""SELECT location_id, year, season, {same('water_area_ha')}, water_body_count FROM grain
        ORDER BY location_id, year, season""",
}


def _uses(name: str, text: str) -> bool:
    padded = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in padded


def _with(sql: str) -> str:
    """The query with the named sub-queries it needs, directly or through others."""
    need: list[str] = []
    for name in reversed(CTES):
        if _uses(name, sql) or any(_uses(name, CTES[n]) for n in need):
            need.insert(0, name)
    heads = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}" if heads else body
    return f"WITH {heads} {body}" if heads else body


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in ORACLE.items()}
