"""Lenient conversions of raw columns to numbers, years, flags and labels.

Missing values are NULL everywhere downstream: NaN is turned into NULL here, because Spark
orders NaN above every number and would let it through a ``>=`` filter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FLAG_FALSE, FLAG_TRUE

# Letters that a cast to DOUBLE accepts in a number ("12d", "0x1p3") but a data file does not.
ODD_LETTERS = "[dDfFxX]"
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def without_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def parse_number(text: Column) -> Column:
    """Text as DOUBLE; NULL unless it is a plain decimal number or an infinity."""
    number = text.try_cast("double")
    return F.when(~text.rlike(ODD_LETTERS) | (F.abs(number) == float("inf")), without_nan(number))


def to_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; text that is not a number, and NaN, become NULL."""
    c, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parse_number(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return without_nan(c.cast("double"))


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that filters above do not compute again.

    The optimizer moves a filter below a projection by copying the projected expressions into it,
    once per mention. It does not do so for the output of a generator, here of a single row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def not_negative(df: DataFrame, name: str) -> Column:
    """Whether the column is a number >= 0, as a test on the column itself where it is numeric."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (F.col(name) >= 0) & ~F.isnan(name)
    return (F.col(name) if isinstance(dtype, T.NumericType) else to_number(df, name)) >= 0


def is_whole(number: Column) -> Column:
    return (number == F.floor(number)) & (F.abs(number) < 1e9)


def to_year(df: DataFrame, name: str) -> Column:
    """The column as INT; anything that is not a whole number becomes NULL."""
    if isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.col(name).cast("int")
    number = to_number(df, name)
    return F.when(is_whole(number), number.try_cast("int"))


def normalize_flag(c: Column, *, trim: bool = True, numeric_text: bool = True) -> Column:
    """Yes/no spellings as 1/0; anything unknown or missing is 0.

    With ``numeric_text`` a number written as text counts as yes when it equals one ("1.0"),
    which is how an integer flag reads back from a file that also had gaps.
    """
    text = F.lower(strip(c.cast("string")) if trim else c.cast("string"))
    flag = F.when(text.isin(*FLAG_TRUE), 1).when(text.isin(*FLAG_FALSE), 0)
    if numeric_text:
        flag = flag.when(parse_number(text) == 1.0, 1)
    return flag.otherwise(0).cast("int")


def known_flag(df: DataFrame, name: str) -> Column:
    """The flag as it is where it is a number; text by the spelling table, with unknown words as NULL."""
    if not isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType)):
        return F.col(name)
    text = F.lower(strip(F.col(name).cast("string")))
    number = parse_number(text)
    return (F.when(text.isin(*FLAG_TRUE) | (number == 1.0), 1).when(text.isin(*FLAG_FALSE) | (number == 0.0), 0)
            .cast("int"))


def clip_flag(c: Column) -> Column:
    """A numeric flag clipped to 0..1 and truncated; missing is 0."""
    number = F.coalesce(without_nan(c.cast("double")), F.lit(0.0))
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)).cast("int")


def aggregate_flag(df: DataFrame, name: str) -> Column:
    """Flag of an aggregation key: text goes through the spelling table, numbers are clipped."""
    if isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType)):
        return normalize_flag(F.col(name))
    return clip_flag(F.col(name))


def label(c: Column, labels: Mapping[int, str]) -> Column:
    """Map values to texts; values without a text become NULL."""
    out = F.lit(None).cast("string")
    for value, text in labels.items():
        out = F.when(c == value, text).otherwise(out)
    return out


def split_list(c: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def normalize_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case headers with spaces and dashes as underscores; a collision is an error."""
    names = [normalize_name(n) for n in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"headers collide after normalising: {twice}")
    return df.toDF(*names)


def coerce_numeric(df: DataFrame, *names: str) -> DataFrame:
    """Replace the named columns by their lenient DOUBLE form."""
    return df.withColumns({n: to_number(df, n) for n in names})


def capitalize(text: Column) -> Column:
    """The first character in upper case and all others in lower case, as labels of charts have it."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))
