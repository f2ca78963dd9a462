"""Column helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.shared import stored

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    Spark's own expressions have no binding of a name to a value, but the parameter of a lambda is one.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def free_name(df: DataFrame | Iterable[str], wish: str) -> str:
    """``wish``, or with underscores before it if a column has this name already (case is ignored)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def col(name: str) -> Column:
    """The column with exactly this name, also if the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def squeeze(text: Column) -> Column:
    """Each run of white space as one blank.

    A blank between two words stays as it is, so only the other runs are matches to replace.
    """
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def with_row_key(df: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    """``df`` with a key that tells all rows apart and orders them by id, NULL last; the key's name.

    The key ends with the row's place in its scan partition. Partitions follow the session's settings and
    the cores of the moment, so the rows are written once with their keys: every reader sees the same.
    """
    name = free_name(df, "row_key")
    key = F.struct(col(id_column).isNull().alias("missing"), col(id_column).alias("id"),
                   F.monotonically_increasing_id().alias("row"))
    return stored(df.withColumn(name, key)), name
