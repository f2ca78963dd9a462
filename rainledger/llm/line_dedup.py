"""Line deduplication: lines that many documents hold stay in one of them.

Texts are cut into lines, each long enough line is normalised and hashed (128 bits), and a hash counts
the distinct documents that hold it. The lines of a hash at or over the threshold are dropped, except in
the document of the largest id, and what is left of a text is put together by position.

How it is spread over the cluster:

* Only hashes are shuffled by line, never a line's text. Lines of a document that are alike are combined
  first; then a hash that a third of all documents hold is one row per task in the second shuffle.
* The hashes over the threshold are a stored table, so the join that finds their lines has a plain shuffle
  on both sides, which adaptive execution can split for a frequent line.
* What is dropped from a document is one row of positions, no longer than the document. Texts are shuffled
  once, to meet these positions.

Rows are told apart by their id and a hash of their text, which are the same in every scan; rows that have
both in common have the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored, working_tables
from .columns import col, free_name, let

#: Code points of a normalised line that is looked at, and documents that make it a repeated one.
MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: White space at the ends that does not count.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(text: Column) -> Column:
    """The lines of a text; NULL and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def repeated_lines(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", min_chars: int = MIN_CHARS,
                   min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, text_hash, drop): the positions, from 0, of the lines to drop from each text that has any."""
    cut = df.select(col(id_column).alias("id"), F.xxhash64(col(text)).alias("text_hash"),
                    F.posexplode(lines(col(text))).alias("pos", "line"))
    # A line's key is never longer than the line: most short lines are gone before they are normalised.
    keyed = cut.filter(F.length("line") >= min_chars).select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    found = stored(keyed.filter(F.length("key") >= min_chars).select(
        "id", "text_hash", "pos", F.xxhash64("key").alias("h0"), F.xxhash64(F.lit(1), "key").alias("h1")))
    once = found.groupBy("h0", "h1", "id", "text_hash").agg(F.lit(1).alias("one"))
    frequent = stored(once.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("keep"))
                      .filter(F.col("documents") >= min_documents))
    dropped = found.join(frequent, ["h0", "h1"]).filter(~F.col("id").eqNullSafe(F.col("keep")))
    return dropped.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def without_repeated_lines(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", **options) -> DataFrame:
    """``df`` with the text without repeated lines, and with ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points that at least ``min_documents`` documents hold loses all its
    lines but those in the document of the largest id. Every other line stays as it is, joined by ``\\n``. A
    NULL or empty text is one empty line; NULL becomes the empty text. Each row is a document; rows equal in
    id and text are one. Several rows of the largest id all keep the line. A NULL id is smaller than any
    other; where all ids are NULL the lines stay. An empty table gives an empty one. Other columns stay; if
    one is called ``n_lines`` or ``n_dropped``, the new one gets underscores before its name.
    """
    with working_tables(df.sparkSession) as keep:
        drops = keep(repeated_lines(df, text, id_column=id_column, **options))
    own_hash, n_lines, n_dropped = (free_name(df, n) for n in ("text_hash", "n_lines", "n_dropped"))
    right = drops.select(F.col("id").alias(free_name(df, "drop_id")), F.col("text_hash").alias(free_name(df, "drop_hash")),
                         F.col("drop").alias(free_name(df, "drop")))
    drop_id, drop_hash, drop = right.columns
    left = df.withColumn(own_hash, F.xxhash64(col(text)))
    both = left.join(right, (F.col(own_hash) == F.col(drop_hash)) & col(id_column).eqNullSafe(F.col(drop_id)), "left")

    def remaining(ls: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop))
        # A text that loses all its lines is empty; sequence() is never empty here.
        return F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")

    whole = F.coalesce(col(text), F.lit(""))
    values = {
        text: F.when(F.col(drop).isNull(), whole).otherwise(let(lines(col(text)), remaining)),
        n_lines: F.size(lines(col(text))).cast("long"), n_dropped: F.coalesce(F.size(drop), F.lit(0)).cast("long"),
    }
    return both.select(*[values[text].alias(c) if c == text else col(c) for c in df.columns],
                       values[n_lines].alias(n_lines), values[n_dropped].alias(n_dropped))


def line_digests(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_sha256 of the text that is left."""
    plain = df.select(col(id_column).alias("id"), col(text).alias("text"))
    return without_repeated_lines(plain, "text", id_column="id", **options).select(
        F.col("id").alias(id_column), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
