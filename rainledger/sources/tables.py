"""Reading observation and intervention tables, and selecting from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_interventions, clean_observations, typed_observations
from ..schema import NULL_TOKENS, SEASONS, Rules, require_columns

LATIN1 = "ISO-8859-1"


def _file_heads(spark: SparkSession, path: str, check: bool) -> DataFrame:
    """(file, h0, h1, valid): a fingerprint of 128 bits of each file's header, and whether all lines are UTF-8.

    Counters of fixed width are updated in place as lines pass by. A header kept as text would make Spark sort
    all lines by file first.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"),
        F.monotonically_increasing_id().alias("id"), F.is_valid_utf8("value").alias("valid") if check else F.lit(True).alias("valid"),
        (F.col("_metadata.file_block_start") == 0).alias("first"))
    # Only lines of a file's first split can be its header; both answers come from one reading.
    order = F.when(F.col("first"), F.col("id"))
    heads = [F.min_by(F.when(F.col("first"), h), order).alias(f"h{i}")
             for i, h in enumerate((F.xxhash64("line"), F.xxhash64(F.lit(1), "line")))]
    return lines.groupBy("file").agg(*heads, F.bool_and("valid").alias("valid"))


def _file_groups(spark: SparkSession, path: str, encoding: str, fallback: str | None) -> list[tuple[list[str], str]]:
    """(files, encoding) of the files that have the same header and the same encoding.

    A file is taken apart from others by its first line and by whether all its lines are valid UTF-8. The
    driver gets a row per file, as for any listing. A single file in a known encoding is not looked at.
    """
    files = spark.read.text(path).inputFiles()
    if len(files) < 2 and fallback is None:
        return [([path], encoding)]
    groups: dict[tuple[int, int, str], list[str]] = {}
    for r in _file_heads(spark, path, fallback is not None).orderBy("file").collect():
        known = encoding if r.valid or fallback is None else fallback
        groups.setdefault((r.h0, r.h1, known), []).append(unquote(r.file))
    return [(names, known) for (*_, known), names in groups.items()] or [([path], encoding)]


def read_csv_text(spark: SparkSession, path: str, *, encoding: str = "UTF-8", fallback: str | None = None,
                  multi_line: bool = False, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """A CSV with header, every column as text, the null tokens as NULL.

    No type inference: it would read everything twice and guess per file. The files of a directory may
    have their columns in any order; a column that a file lacks is NULL there. With ``fallback`` a file
    with a line that is not UTF-8 is read in that encoding, and others are not.
    """
    tokens, parts = list(null_tokens), []
    for files, known in _file_groups(spark, path, encoding, fallback):
        df = (spark.read.option("header", True).option("encoding", known).option("multiLine", multi_line)
              .option("escape", '"').csv(files))
        parts.append(df.select(*[
            F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) if tokens else F.col(f"`{c}`")
            for c in df.columns
        ]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def is_utf8(spark: SparkSession, path: str) -> bool:
    """False if a line of the files is not valid UTF-8. Stops at the first such line.

    The text source hands over the bytes of a line unchanged.
    """
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def read_observations(spark: SparkSession, path: str, *, clean: bool = True, rules: Rules = Rules(),
                      **csv) -> DataFrame:
    """Observations from CSV, cleaned, or with ``clean=False`` typed only."""
    raw = read_csv_text(spark, path, **csv)
    return clean_observations(raw, rules) if clean else typed_observations(raw, rules)


def read_interventions(spark: SparkSession, path: str, *, clean: bool = True, rules: Rules = Rules(),
                       encoding_fallback: bool = True, strict: bool = True, **csv) -> DataFrame:
    """Intervention records from CSV; files that are not UTF-8 are read as Latin-1.

    A caller who names the encoding saves the look at every file.
    """
    if encoding_fallback and "encoding" not in csv:
        csv = {**csv, "fallback": LATIN1}
    raw = read_csv_text(spark, path, **csv)
    if strict and raw.isEmpty():
        raise ValueError(f"no records in {path}")
    return clean_interventions(raw, rules) if clean else raw


def parse_locations(text: str) -> list[str]:
    """Comma-separated identifiers as a list; none at all is an error."""
    found = [part.strip() for part in text.split(",") if part.strip()]
    if not found:
        raise ValueError("no location ids given")
    return found


def check_seasons(seasons: Sequence[str] | None) -> list[str]:
    """The wanted seasons in lower case; none at all means every season."""
    chosen = [s.strip().lower() for s in seasons or SEASONS]
    unknown = [s for s in chosen if s not in SEASONS]
    if unknown:
        raise ValueError(f"invalid seasons: {unknown}; valid: {list(SEASONS)}")
    return chosen


def check_years(start: int, end: int) -> None:
    latest = date.today().year + 5
    for name, year in (("start", start), ("end", end)):
        if isinstance(year, bool) or not isinstance(year, int):
            raise ValueError(f"{name} year must be an integer")
        if not 1900 <= year <= latest:
            raise ValueError(f"{name} year {year} is outside 1900..{latest}")
    if start > end:
        raise ValueError("start year must not be after end year")


def select_observations(df: DataFrame, locations: Sequence[str], start: int, end: int,
                        seasons: Sequence[str] | None = None, *, location: str = "location_id",
                        year: str = "year", season: str = "season") -> DataFrame:
    """Rows of the given locations, inclusive years and seasons. All three reach the file scan."""
    wanted = [loc.strip() for loc in locations if isinstance(loc, str) and loc.strip()]
    if not wanted:
        raise ValueError("locations cannot be empty")
    check_years(start, end)
    chosen = check_seasons(seasons)
    require_columns(df, location, year, season)
    return df.filter(F.col(location).isin(wanted) & F.col(year).between(start, end) & F.col(season).isin(chosen))

