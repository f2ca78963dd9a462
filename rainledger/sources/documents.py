"""Irregular JSON documents: seasonal series, spatial units, elevation grids.

Documents are parsed to VARIANT, so one bad element loses only itself. A typed ``from_json`` would
lose the whole series around it. Elements are taken apart as ``array<variant>`` and
``map<string,variant>``, which are NULL when the element has another shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import computed_once, parse_number, strip
from ..operators.cleaning import clean_observations
from ..schema import SEASONS, UNIT_TYPES, Rules, require_columns

LIST, OBJECT = "array<variant>", "map<string,variant>"
_INFO = "struct<area_ha: double, count: bigint, quality: string>"
_YEARS = f"array<struct<year: int, seasons: struct<{', '.join(f'{s}: {_INFO}' for s in SEASONS)}>>>"
#: The usual shape of a series, and where the reader notes a document that has another one.
TYPED = f"timeseries {_YEARS}, data struct<timeseries: {_YEARS}>, __other string"
#: What the typed reader would take for something else: JSON null (absent), numbers that JSON does not have,
#: escapes, and a quality that is no text; and what it would fail at, which costs more than not to try: numbers
#: that are no numbers, years and counts with a fraction, lists of something other than objects.
UNUSUAL = (r'null|NaN|Infinity|\\|"quality"\s*:\s*[^"\s]|"(?:year|area_ha|count)"\s*:\s*[^-0-9\s]'
           r'|"(?:year|count)"\s*:\s*-?[0-9]+[.eE]|\[\s*[^{\s\]]')
#: No JSON begins like this, but pages with an error message do.
MARKUP = r"^\s*<"


def documents_from(text: DataFrame) -> DataFrame:
    """(location_id, document) of text files; the file name without its suffix is the id."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[A-Za-z]+)?$", 1)
    return text.select(F.url_decode(stem).alias("location_id"), F.col("value").alias("document"))


def read_documents(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Documents of a landing directory, one per file or one per line."""
    return documents_from(spark.read.text(path, wholetext=not one_per_line))


def _parsed(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(__id, __doc) with the document as VARIANT, NULL if it is no JSON at all."""
    return df.select(F.col(id_col).alias("__id"), _parse(df, F.col(json_col)).alias("__doc"))


def _parse(df: DataFrame, text: Column) -> Column:
    """A document as VARIANT, NULL if it is no JSON at all.

    Of a key that is repeated in an object the last value counts, as in most JSON readers. Spark has a
    session setting for it, which is switched on here and stays on: plans read it when they are run. A
    document with bare NaN or Infinity, which JSON does not have, is read by the reader that allows them
    as text.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.when(~text.rlike(MARKUP), F.coalesce(F.try_parse_json(text), F.from_json(text, "variant")))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _has(v: Column, path: str) -> Column:
    """Whether the path leads to anything, JSON null included."""
    return _get(v, path, "variant").isNotNull()


def _series(v: Column) -> Column:
    """The list of yearly entries: under timeseries, data.timeseries, data, or the document itself."""
    return (
        F.when(_has(v, "$.timeseries"), _get(v, "$.timeseries", LIST))
        .when(_has(v, "$.data.timeseries"), _get(v, "$.data.timeseries", LIST))
        .when(_has(v, "$.data"), _get(v, "$.data", LIST))
        .otherwise(_get(v, "$", LIST))
    )


def _field(v: Column, name: str) -> Column:
    """A field as VARIANT, from which text and kind are read without walking the object again."""
    return _get(v, f"$.{name}", "variant")


def _text(field: Column) -> Column:
    return _get(field, "$", "string")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside other lambdas too."""
    return F.get(F.transform(F.array(value), use), 0)


def _year(field: Column, text: Column | None = None) -> Column:
    """A whole number, or text of digits only, within 1900..2100. ``text`` is that of the field, if it is there."""
    text = _text(field) if text is None else text
    # 2022.0 also has the text "2022"; only its kind tells it apart.
    whole = _kind(field).isin("BIGINT", "STRING")
    return F.when(text.rlike("^0*(19[0-9]{2}|20[0-9]{2}|2100)$") & whole, text.try_cast("int"))


def _number(field: Column, text: Column | None = None) -> Column:
    """A JSON number or boolean, or text that is a number, as DOUBLE; 0 if it is none, NULL if it is NaN."""
    text = _text(field) if text is None else text
    truth = F.when(_kind(field) == "BOOLEAN", _get(field, "$", "boolean"))
    number = F.coalesce(parse_number(text), truth.cast("int").cast("double"), F.lit(0.0))
    return F.when(~F.coalesce(F.lower(strip(text)).rlike("^[+-]?nan$"), F.lit(False)), number)


def _count(field: Column) -> Column:
    """A whole count: decimals truncated, text only if whole, negative or unusable as 0."""
    text = strip(_text(field))
    is_text = _kind(field) == "STRING"
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    value = F.when(is_text, whole).otherwise(_get(field, "$", "double").try_cast("bigint"))
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("bigint")


def _entries(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    require_columns(df, json_col, id_col)
    parsed = _parsed(df, id_col, json_col)
    # explode() would first filter on a second copy of its argument and so parse every document twice.
    return parsed.select("__id", F.explode_outer(_series(F.col("__doc"))).alias("__entry"))


def _years(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(__id, year, __seasons) of the entries with a usable year, of documents with an id."""
    entry = F.col("__entry")
    fields = computed_once(_entries(df, json_col, id_col), {
        "__y": _field(entry, "year"), "__seasons": _get(entry, "$.seasons", OBJECT)})
    years = computed_once(fields, {"year": _year(F.col("__y"))})
    return years.filter(F.col("year").isNotNull() & (strip(F.col("__id")) != ""))


def _typed(text: Column) -> Column:
    """The document by the usual schema; ``__other`` is NULL if every value in it had its type.

    NULL for a document that can be seen to be of another shape.
    """
    plain = F.ltrim(text).startswith("{") & F.rtrim(text).endswith("}") & ~text.rlike(UNUSUAL)
    return F.when(plain, F.from_json(text, TYPED, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__other", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))


def _usual(typed: Column) -> Column:
    """Whether the typed reader has read the document as the general one would."""
    found = typed["timeseries"].isNotNull() | typed["data"]["timeseries"].isNotNull()
    return F.coalesce(typed["__other"].isNull() & found, F.lit(False))


def _cell(year: Column, season: Column, area: Column, count: Column, quality: Column) -> Column:
    return F.struct(year.alias("year"), season.alias("season"), area.alias("__area"), count.alias("__n"), quality.alias("__q"))


def _typed_cells(typed: Column) -> Column:
    """The cells of a document of the usual shape."""
    def cells(entry: Column) -> Column:
        infos = F.array(*[F.struct(F.lit(s).alias("season"), entry["seasons"][s].alias("info")) for s in SEASONS])
        present = F.filter(infos, lambda x: x["info"].isNotNull() & entry["year"].between(1900, 2100))
        return F.transform(present, lambda x: _cell(
            entry["year"], x["season"], F.coalesce(x["info"]["area_ha"], F.lit(0.0)),
            F.greatest(F.coalesce(x["info"]["count"], F.lit(0)), F.lit(0)), F.coalesce(x["info"]["quality"], F.lit("good"))))

    return F.flatten(F.transform(F.coalesce(typed["timeseries"], typed["data"]["timeseries"]), cells))


def _general_cells(doc: Column) -> Column:
    """The cells of a document of any shape; a season whose value is no object is a NULL."""
    def cell(year: Column, season: Column, info: Column) -> Column:
        area = _once(info["area_ha"], lambda field: _once(_text(field), lambda text: _number(field, text)))
        quality = F.when(F.map_contains_key(info, F.lit("quality")), _text(info["quality"])).otherwise(F.lit("good"))
        return F.when(info.isNotNull(), _cell(year, season, area, _once(info["count"], _count), quality))

    def seasons(entry: Column, year: Column) -> Column:
        found = F.filter(F.map_entries(_get(entry, "$.seasons", OBJECT)), lambda x: x["key"].isin(*SEASONS))
        return F.when(year.isNotNull(), F.transform(
            found, lambda x: _once(_get(x["value"], "$", OBJECT), lambda info: cell(year, x["key"], info))))

    def cells(entry: Column) -> Column:
        year = _once(_field(entry, "year"), lambda field: _once(_text(field), lambda text: _year(field, text)))
        return _once(year, lambda y: seasons(entry, y))

    # An entry of another shape has no cells, and flatten() gives NULL for a list with a NULL in it.
    return F.flatten(F.filter(F.transform(_series(doc), cells), lambda x: x.isNotNull()))


def flatten_timeseries(df: DataFrame, json_col: str = "document", id_col: str = "location_id") -> DataFrame:
    """One observation per year and season of each document.

    Entries without a usable year, unknown seasons and values of the wrong shape are skipped. An
    unusable area or count becomes 0. Areas that are NaN (here NULL) or out of range are kept: cleaning
    removes them.

    A document of the usual shape is read once by its schema. Only one that the schema does not fit exactly
    is read to VARIANT, also once, and taken apart value by value.
    """
    require_columns(df, json_col, id_col)
    text, typed = F.col("__text"), F.col("__typed")
    named = df.filter(strip(F.col(id_col)) != "").select(strip(F.col(id_col)).alias("location_id"), F.col(json_col).alias("__text"))
    read = computed_once(named, {"__typed": _typed(text)})
    parsed = computed_once(read, {"__doc": F.when(~_usual(typed), _parse(df, text))})
    cells = F.when(_usual(typed), _typed_cells(typed)).otherwise(_general_cells(F.col("__doc")))
    values = parsed.select("location_id", F.inline_outer(cells))
    return values.filter(F.col("year").isNotNull()).select(
        "location_id", "year", "season", F.col("__area").alias("water_area_ha"), F.col("__n").alias("water_body_count"),
        F.col("__q").alias("data_quality"))


def load_observations(df: DataFrame, json_col: str = "document", id_col: str = "location_id",
                      rules: Rules = Rules()) -> DataFrame:
    """Documents of all locations to cleaned observations, in one pass."""
    return clean_observations(flatten_timeseries(df, json_col, id_col), rules)


def document_rejects(df: DataFrame, json_col: str = "document", id_col: str = "location_id") -> DataFrame:
    """Documents and yearly entries that cannot be used, as (id, reason, position)."""
    require_columns(df, json_col, id_col)
    doc = F.col("__doc")
    parsed = _parsed(df, id_col, json_col).withColumnRenamed("__id", "location_id")
    series = parsed.withColumn("__series", _series(doc))
    bad_document = F.when(doc.isNull(), "not_json").when(F.col("__series").isNull(), "no_list_of_years")
    entries = series.select("location_id", bad_document.alias("__bad"),
                            F.posexplode_outer("__series").alias("position", "__entry"))
    entry = F.col("__entry")
    as_object = _get(entry, "$", OBJECT)
    reason = (
        F.when(F.col("__bad").isNotNull(), F.col("__bad"))
        .when(F.col("position").isNull(), F.lit(None).cast("string"))
        .when(as_object.isNull(), "entry_not_object")
        .when(~F.map_contains_key(as_object, F.lit("year")), "entry_without_year")
        .when(_year(_field(entry, "year")).isNull(), "invalid_year")
    )
    return entries.select("location_id", reason.alias("reason"), "position").filter(F.col("reason").isNotNull())


def season_rejects(df: DataFrame, json_col: str = "document", id_col: str = "location_id",
                   rules: Rules = Rules()) -> DataFrame:
    """Seasons of usable years that are skipped, changed or removed later: (location_id, year, season, reason).

    Skipped: unknown seasons, values that are no object. Changed to 0: areas and counts that are no
    number, negative counts. Removed by cleaning: areas that are NaN or out of range. A season is listed
    under its first reason. Fields that are absent take their defaults and are no fault.
    """
    cells = _years(df, json_col, id_col).select("__id", "year", F.explode("__seasons").alias("season", "__info"))
    info = F.col("__info")
    cells = computed_once(cells, {
        "__area": _number(_field(info, "area_ha")), "__raw": _get(info, "$.area_ha", "string"),
        "__count": strip(_get(info, "$.count", "string")), "__kind": _kind(info)})
    area, count = F.col("__area"), F.col("__count")
    is_number = parse_number(F.col("__raw")).isNotNull() | F.col("__raw").isin("true", "false")
    reason = (
        F.when(~F.col("season").isin(*SEASONS), "unknown_season")
        .when(~F.col("__kind").startswith("OBJECT"), "info_not_object")
        .when(area.isNull(), "missing_area")
        .when(F.col("__raw").isNotNull() & ~is_number, "invalid_area")
        .when(~area.between(rules.area_min, rules.area_max), "area_out_of_range")
        .when(count.isNotNull() & parse_number(count).isNull(), "invalid_count")
        .when(parse_number(count) < 0, "negative_count"))
    return cells.select(strip(F.col("__id")).alias("location_id"), "year", "season", reason.alias("reason")) \
        .filter("reason IS NOT NULL")


def load_report(df: DataFrame, json_col: str = "document", id_col: str = "location_id",
                rules: Rules = Rules()) -> DataFrame:
    """Outcome per location: documents, observations kept after cleaning, and ``loaded`` or ``empty``.

    A load of which no row is ``loaded`` has failed; locations without a name are left out, as in loading.
    """
    require_columns(df, json_col, id_col)
    kept = load_observations(df, json_col, id_col, rules).groupBy(F.col("location_id").alias("__place")) \
        .agg(F.count(F.lit(1)).alias("__rows"))
    name = strip(F.col(id_col))
    found = df.filter(name != "").groupBy(name.alias("location_id")).agg(F.count(F.lit(1)).alias("documents"))
    return found.join(kept, F.col("location_id") == F.col("__place"), "left").select(
        "location_id", "documents", F.coalesce("__rows", F.lit(0)).alias("observations"),
        F.when(F.col("__rows") > 0, "loaded").otherwise("empty").alias("status"))


def spatial_units(df: DataFrame, unit_type: str = "village", state: str | None = None,
                  json_col: str = "document") -> DataFrame:
    """Units of one type, optionally of one state, that have both an id and a name."""
    wanted = unit_type.strip().lower()
    if wanted not in UNIT_TYPES:
        raise ValueError(f"invalid unit type {unit_type!r}; valid: {list(UNIT_TYPES)}")
    if state is not None and not state.strip():
        raise ValueError("state must be a non-empty string if given")
    require_columns(df, json_col)
    parsed = _parsed(df, json_col, json_col)
    # explode() would copy its argument into a filter and so parse every document twice.
    units = parsed.select(F.explode_outer(_get(F.col("__doc"), "$.data", LIST)).alias("u"))
    u = F.col("u")
    fields = _get(u, "$", OBJECT)
    known = units.filter(F.map_contains_key(fields, F.lit("id")) & F.map_contains_key(fields, F.lit("name")))
    names = ("id", "name", "type", "state")
    extra = F.map_filter(fields, lambda k, _: ~k.isin(*names))
    out = known.select(*[_get(u, f"$.{n}", "string").alias(n) for n in names],
                       F.transform_values(extra, lambda _, v: F.nullif(v.try_cast("string"), F.lit("NaN"))).alias("extras"))
    out = out.filter(F.col("type") == wanted)
    return out if state is None else out.filter(F.col("state") == state.strip())


def elevation_cells(df: DataFrame, json_col: str = "document", id_col: str = "location_id") -> DataFrame:
    """Cells of an elevation grid as (location_id, row, col, elevation); no cells without a grid.

    A cell that is NaN or no number has a NULL elevation.
    """
    require_columns(df, json_col, id_col)
    parsed = _parsed(df, id_col, json_col)
    rows = parsed.select(F.col("__id").alias("location_id"),
                         F.posexplode_outer(_get(F.col("__doc"), "$.data.elevation_grid", LIST)).alias("row", "__row"))
    cells = rows.select("location_id", "row", F.posexplode(_get(F.col("__row"), "$", LIST)).alias("col", "__cell"))
    elevation = _get(F.col("__cell"), "$", "double")
    return cells.select("location_id", "row", "col", F.when(~F.isnan(elevation), elevation).alias("elevation"))
