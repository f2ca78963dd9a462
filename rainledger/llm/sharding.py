"""Sharding by a lookup table that shards fill in turns.

Every shard prefers the slots of a table of prime size in an order of its own: an offset and a step,
both from hashes of its name. The shards take turns, and each claims the first slot of its order that is
free, until the table is full. A document's slot is a hash of its key modulo the size. The table is
broadcast, so placement is one lookup per row and moves no data. Shards get equally many slots, give or
take one, and when a shard joins or leaves only few slots between other shards change hands.

The table depends on the names of the shards alone and has as many rows as slots, which bounds what is
filled on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, free_name

#: Slots; a prime number, and at least a hundred times the number of shards for an even filling.
SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard (its place in ``shards``) for each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have different names, and there must be one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    place, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    # Names decide whose turn is first, so the order of the list doesn't matter.
    turns, owner, free = sorted(range(len(shards)), key=lambda i: shards[i]), [-1] * slots, slots
    while free:
        for i in turns:
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the MD5 of the key as text; a NULL key has the slot of the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(head, 16, 10).cast("bigint") % slots


def place(df: DataFrame, shards: Sequence[str], key: str = "doc_id", *, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``: every row has one, rows of equal keys the same.

    A column of ``df`` with one of these names is kept, and the new one gets underscores before its name.
    An empty table gives an empty result.
    """
    at, name = free_name(df, "slot"), free_name(df, "shard")
    spark = df.sparkSession
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias(at, "owner")) \
        .select(F.col(at).cast("bigint").alias(at), F.get(names, F.col("owner").cast("int")).alias(name))
    return df.withColumn(at, slot(col(key), slots)).join(F.broadcast(table), at).select(*[col(c) for c in df.columns], at, name)


def write_shards(df: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", **options) -> None:
    """``df`` as Parquet below one folder per shard; a shard with many rows is several files."""
    placed = place(df, shards, key, **options)
    by = placed.columns[-1]
    placed.hint("rebalance", col(by)).write.partitionBy(by).parquet(path)
