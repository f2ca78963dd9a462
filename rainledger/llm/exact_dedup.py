"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed size. The distinct blocks are sorted and numbered, so equal
blocks, and only they, have the same integer name. Adjacent names are then paired, the distinct pairs
are sorted and numbered in the same way, and so on until one name is left of each document. Texts of
the same number of blocks are equal if and only if their last names are equal: no hash decides.

How it is spread over the cluster:

* Block texts are shuffled once, to find the distinct ones; equal blocks are combined before the
  shuffle, so a block that a third of all rows hold costs no more than any other.
* Names return to the documents by a fingerprint of 128 bits. The table of distinct blocks shows
  whether two different blocks share a fingerprint. If so, the join compares the texts as well.
* Later rounds handle only pairs of integers of documents that still have more than one name; their
  number is halved in each round. A text of a million blocks takes 20 rounds.
* Joins have a plain shuffle or a stored table on both sides, so that adaptive execution can split a
  frequent name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored, working_tables
from .columns import col, let, squeeze, with_row_key

#: Bytes in a block.
BLOCK = 4096


def fingerprint(block: Column) -> list[Column]:
    """Two independent hashes of 64 bits."""
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def _blocks(data: Column, size: int) -> Column:
    """The bytes cut into blocks; no bytes are one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.length(data) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in the order of the keys with an integer each: sorted ranges, numbered within and across."""
    ranged = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumn("name", F.monotonically_increasing_id()))


def block_names(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", normalize: bool = True,
                block: int = BLOCK, hashes: Callable[[Column], list[Column]] = fingerprint) -> DataFrame:
    """The identity of each row's text: (id, text_sha256, blocks, name), stored.

    Rows have the same ``blocks`` and ``name`` if and only if their texts are equal, with
    ``normalize`` after each run of white space became one blank. A NULL text counts as empty. A
    NULL or repeated id is kept as it is: every row is one of its own. An empty table gives an empty one.
    """
    value = F.coalesce(col(text), F.lit(""))
    data = F.encode(squeeze(value) if normalize else value, "UTF-8")
    pieces = let(data, lambda d: F.struct(F.sha2(d, 256).alias("sha"), _blocks(d, block).alias("blocks")))
    rows = df.select(col(id_column).alias("id"), pieces.alias("p"))
    distinct = (
        rows.select(F.explode("p.blocks").alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
        .select("block", F.struct(*[h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("block")))]).alias("key"))
    )
    # Only the keys are stored: no text is shuffled again.
    keyed = stored(distinct.select("key", F.when(F.lit(False), F.col("block")).alias("block")))
    clash = keyed.groupBy("key").count().filter("count > 1")
    by_text = not clash.isEmpty()
    if by_text:
        keyed = stored(distinct)
    names = _numbered(keyed, ["key", "block"])
    on = ["key", "block"] if by_text else ["key"]
    parts = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "p.sha", F.size("p.blocks").alias("blocks"),
        F.transform("p.blocks", lambda b: F.struct(
            F.struct(*[h.alias(f"h{i}") for i, h in enumerate(hashes(b))]).alias("key"),
            (b if by_text else F.lit(None).cast("binary")).alias("block"))).alias("cut"))
    flat = parts.select("row", F.posexplode("cut").alias("pos", "b"), "blocks",
                        F.when(F.col("pos") == 0, F.struct("id", "sha")).alias("doc")) \
        .select("row", "pos", "blocks", "doc", "b.key", "b.block")
    level = stored(flat.join(names.select(*on, "name"), on).select("row", "pos", "blocks", "doc", "name"))
    done = level.filter("blocks = 1")
    rest = level.filter("blocks > 1").withColumn("left", F.col("blocks"))
    left = rest.agg(F.max("blocks")).first()[0] or 0
    while left > 1:
        rest, left = stored(_paired(rest)), (left + 1) // 2
        done = done.unionByName(rest.filter("left = 1").select(done.columns))
        rest = rest.filter("left > 1")
    return done.select(F.col("doc.id").alias("id"), F.col("doc.sha").alias("text_sha256"), "blocks", "name")


def _paired(level: DataFrame) -> DataFrame:
    """One round: names at positions 2i and 2i + 1 become the name of their pair at position i."""
    pairs = (
        level.groupBy("row", "blocks", "left", F.expr("pos div 2").cast("int").alias("pos"))
        .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
             F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
             F.first("doc", ignorenulls=True).alias("doc"))
    )
    pairs = stored(pairs)
    names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
    return pairs.join(names, ["a", "b"]).select(
        "row", "pos", "blocks", "doc", "name", ((F.col("left") + 1) / 2).cast("int").alias("left"))


def exact_duplicates(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays; a NULL id is larger than any other. Among repeated rows of
    the smallest id each is marked as kept, as the id is all that tells rows apart.
    """
    named = block_names(df, text, id_column=id_column, **options)
    groups = stored(named.groupBy("blocks", "name").agg(F.min("id").alias("keep_id"),
                                                        F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["blocks", "name"]).select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that are first of their text by id; repeated rows leave one."""
    keyed, key = with_row_key(df, id_column)
    with working_tables(df.sparkSession) as keep:
        found = exact_duplicates(keyed.select(key, col(text).alias("text")), id_column=key, **options)
        dropped = keep(found.filter("NOT kept").select(col(key)["row"].alias("row")))
    return keyed.join(dropped, col(key)["row"] == dropped["row"], "left_anti").select(*[col(c) for c in df.columns])
