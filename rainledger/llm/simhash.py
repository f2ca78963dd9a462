"""Near-duplicate detection: SimHash fingerprints, pigeonring filtering, connected components.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``distance`` bits are linked, and
a component is what links connect. Everything after the fingerprints runs on distinct fingerprints,
so copies never meet each other in a join.

**Filter.** Cut the 64 bits into a ring of ``m`` segments. If two fingerprints differ in at most t
bits, there is a segment from which every chain of l consecutive segments differs in at most
``l * t / m`` bits, for all l up to m (the pigeonring principle). With m = t + 1 the first segment of
that chain is equal, two segments differ in at most one bit, three in two, and so on. The join key is
the first two segments of the chain: equal in the first, and in the second equal but for one bit that
is masked out. Rows are dealt by the first segment alone and get their keys after that. The longer chains are checked by bit counts inside the join, before the full distance.

**Links.** Two rounds:

1. Fingerprints that differ in one bit. With that bit masked out, a group has two members at most, so
   a minimum and a maximum per group give the link and no join is needed. Their components contract
   dense clouds of near copies.
2. All other links, by the filter. Two fingerprints of one component need no link. In each group of
   a join key one component has the most members; the other members are joined with the whole group,
   so a cloud that fills a group doesn't meet itself.

Links are never collected; components are found by repeated grouping and joining of tables in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored, working_tables
from .columns import col, with_row_key

#: Bits that may differ between linked fingerprints.
DISTANCE = 4
#: Words in a shingle.
WIDTH = 4


def _fingerprints(width: int):
    """Arrow batches of (text) to (fp): 64-bit SimHash as a signed integer."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        # Non-breaking forms of white space are parts of words; bytes.split() would split at the same
        # six characters as the definition and no others.
        one_bit = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

        def simhash(text: bytes) -> int:
            words = text.translate(lower).split()
            n = len(words)
            if not n:
                return 0
            flat = b" ".join(words)
            if n <= width:
                # One shingle: each of its bits is set in all hashes.
                return xxh64_intdigest(flat, 42)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            pairs = zip(starts[: n - width + 1].tolist(), ends[width - 1:].tolist())
            hashes = np.fromiter([xxh64_intdigest(flat[a:b], 42) for a, b in pairs], np.uint64, n - width + 1)
            counts = np.zeros(64, np.int64)
            for i in range(0, len(hashes), 65536):
                part = np.ascontiguousarray(hashes[i:i + 65536], dtype="<u8").view(np.uint8)
                counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.bitwise_or.reduce(one_bit[counts * 2 > len(hashes)], initial=np.uint64(0)))

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((simhash(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts),
                                np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row's words, as BIGINT.

    A-Z become lower case. Words are split at blanks, tabs, line feeds, vertical tabs, form feeds and
    carriage returns. Each run of ``width`` words, joined by blanks, gives one XXH64 with seed 42,
    repeats included; a text with fewer words is one run. A bit is set if it is set in over half of the
    hashes. NULL and texts without a word have fingerprint 0.
    """
    picked = df.select(col(id_column).alias("id"), col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_fingerprints(width), f"id {kind}, fp bigint")


def _segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``m`` segments as equal as possible."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(fp: Column, segment: tuple[int, int]) -> Column:
    first, bits = segment
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _chains_fit(other: Column, start: Column, distance: int) -> Column:
    """Whether all chains from the segment ``start`` keep their budgets; ``other``: bits that differ."""
    ring = _segments(distance + 1)
    m = len(ring)
    counts = [F.bit_count(_part(other, s)) for s in ring]

    def from_segment(i: int) -> Column:
        total, fits = counts[i], counts[i] <= 0
        for length in range(2, m + 1):
            total = total + counts[(i + length - 1) % m]
            fits = fits & (total <= length * distance // m)
        return fits

    cases = F.when(start == 0, from_segment(0))
    for i in range(1, m):
        cases = cases.when(start == i, from_segment(i))
    return cases


#: A first segment with more rows than this, and than ``HOT_TIMES`` the mean, is dealt by the whole key.
HOT_ROWS, HOT_TIMES = 2_000, 8
#: Bits below the chain's place in a key.
PLACE = 48


def _starts(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes`` with a row per segment: the segment's number ``i`` and its bits ``first``."""
    ring = _segments(distance + 1)
    return nodes.select("*", F.posexplode(F.array(*[_part(F.col("fp"), s) for s in ring])).alias("i", "first"))


def _keys(starts: DataFrame, distance: int) -> DataFrame:
    """(fp, comp, i, first, key): a row per bit of the second segment, with this bit masked out.

    The key is one integer: the first segment's number and the masked bit's place, and below them the bits
    of the two segments.
    """
    ring = _segments(distance + 1)
    m = len(ring)
    keys = None
    for i in range(m):
        first_bit, bits = ring[(i + 1) % m]
        second = _part(F.col("fp"), ring[(i + 1) % m])
        whole = F.shiftleft(F.col("first"), bits).bitwiseOR(second)
        rows = F.array(*[F.lit((i * 64 + first_bit + b) << PLACE).bitwiseOR(whole.bitwiseAND(F.lit(~(1 << b))))
                         for b in range(bits)])
        keys = F.when(F.col("i") == i, rows) if keys is None else keys.when(F.col("i") == i, rows)
    return starts.select("fp", "comp", "i", "first", F.explode(keys).alias("key"))


def _mixed_members(nodes: DataFrame, distance: int) -> DataFrame:
    """The (key, fp, comp) of all keys that two components or more have.

    Rows are shuffled once per segment, by its bits, and get their keys afterwards: a window over the key
    needs no further shuffle, and nearly all keys end there. The few segments whose bits very many
    fingerprints share are found by a count and dealt by the whole key, with minima and maxima combined
    before the shuffle.
    """
    starts = _starts(nodes, distance)
    counts = stored(starts.groupBy("i", "first").count())
    mean = counts.agg(F.avg("count")).first()[0] or 0
    hot = counts.filter(F.col("count") > max(HOT_ROWS, HOT_TIMES * mean)).select("i", "first")
    some_hot = not hot.isEmpty()
    alike = Window.partitionBy("i", "first", "key")
    cold = _keys((starts.join(hot, ["i", "first"], "left_anti") if some_hot else starts).repartition("i", "first"), distance)
    found = (cold.withColumn("low", F.min("comp").over(alike)).withColumn("high", F.max("comp").over(alike))
             .filter("low < high").select("key", "fp", "comp"))
    if some_hot:
        keyed = _keys(starts.join(hot, ["i", "first"]), distance)
        mixed = stored(keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                       .filter("low < high").select("key"))
        found = found.unionByName(keyed.join(mixed, "key").select("key", "fp", "comp"))
    return stored(found)


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between components that connect what lies within ``distance`` bits.

    ``nodes``: distinct (fp, comp), a stored table; comp is a component that is known already. Of every
    two fingerprints within the distance, either both have one component already or their components
    are linked here. ``distance`` is at least 2.
    """
    # Only groups with two components or more can give a link.
    members = _mixed_members(nodes, distance)
    largest = (
        members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top")).select("key", F.col("top.comp").alias("major")))
    marked = stored(members.join(stored(largest), "key"))
    a, b = marked.filter("comp <> major").alias("a"), marked.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # Two members outside the largest component meet twice; one of the two meetings is enough.
    once = (F.col("b.comp") == F.col("b.major")) | (F.col("a.fp") < F.col("b.fp"))
    # Two that are equal in the second segment share all of its keys; the one of its first bit is enough.
    ring = _segments(distance + 1)
    first_bits = [i * 64 + ring[(i + 1) % len(ring)][0] for i in range(len(ring))]
    place = F.shiftrightunsigned("a.key", PLACE)
    once = once & (place.isin(first_bits)
                   | (F.expr(f"shiftrightunsigned(a.fp ^ b.fp, cast(shiftrightunsigned(a.key, {PLACE}) % 64 as int)) & 1") == 1))
    return (
        a.join(b, [F.col("a.key") == F.col("b.key"),
                   F.col("a.comp") != F.col("b.comp"), once, F.bit_count(differ) <= distance,
                   _chains_fit(differ, (place / 64).cast("int"), distance)])
        .select(F.least("a.comp", "b.comp").alias("a"), F.greatest("a.comp", "b.comp").alias("b")).distinct()
    )


def one_bit_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in exactly one bit."""
    masks = [F.struct(F.lit(i).cast("tinyint").alias("bit"),
                      F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i)))).alias("rest")) for i in range(64)]
    with_bit = F.col("rest").bitwiseOR(F.expr("shiftleft(1L, bit)"))
    return (nodes.select(F.inline(F.array(*masks))).groupBy("bit", "rest").count().filter("count = 2")
            .select(F.col("rest").alias("a"), with_bit.alias("b")))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): the smallest node that it is connected to.

    Each round, every node takes the smallest of its neighbours' and its own label, links are moved to
    the labels, and labels are followed one step. The links between different labels are at least
    halved, so a chain of n nodes takes a logarithmic number of rounds. Minima are combined before
    the shuffle; the joins have stored tables on both sides.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
                      .select(F.col("a").alias("node"), "to"))
        step = _followed(step)
        moved = (
            links.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        links = stored(moved)
        if labels is None:
            labels = step
        else:
            old = labels.select("node", F.col("to").alias("at"))
            labels = stored(old.join(step.select(F.col("node").alias("at"), F.col("to").alias("next")), "at", "left")
                            .select("node", F.coalesce("next", "at").alias("to")))
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("comp"))
    return labels.select("node", F.col("to").alias("comp"))


def _followed(step: DataFrame) -> DataFrame:
    """(node, to) with each ``to`` replaced by the end of its path; paths lead to smaller nodes."""
    while True:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = stored(step.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")))
        if not step.agg(F.max("moved")).first()[0]:
            return step.select("node", "to")
        step = step.select("node", "to")


def near_duplicates(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", width: int = WIDTH,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id of the rows connected by links, the row itself included.
    NULL and empty texts have fingerprint 0 and are linked like any other. A NULL id takes part in the
    links; a component of nothing but NULL ids has a NULL component_id. Repeated ids are kept. An empty
    table gives an empty result.
    """
    prints = stored(fingerprints(df, text, id_column=id_column, width=width))
    with working_tables(df.sparkSession) as keep:
        known = keep(_known(prints, distance))
    return prints.join(known, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _known(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (id, fp)."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    close = components(one_bit_links(nodes)) if distance else None
    seen = nodes.select("fp").withColumn("comp", F.col("fp"))
    if close is not None:
        seen = stored(nodes.select("fp").join(close.withColumnRenamed("node", "fp"), "fp", "left")
                      .select("fp", F.coalesce("comp", "fp").alias("comp")))
    if distance > 1:
        wider = components(near_links(seen, distance))
        seen = stored(seen.join(wider.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
                      .select("fp", F.coalesce("to", "comp").alias("comp")))
    # Stored, so that the join has a plain shuffle on both sides and a large component can be split.
    smallest = stored(nodes.join(seen, "fp").groupBy("comp").agg(F.min("first_id").alias("component_id")))
    return seen.join(smallest, "comp").select("fp", "component_id")


def without_near_duplicates(df: DataFrame, text: str = "text", *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that have the smallest id of their component."""
    keyed, key = with_row_key(df, id_column)
    row = col(key)["row"]
    with working_tables(df.sparkSession) as keep:
        found = near_duplicates(keyed.select(key, col(text).alias("text")), id_column=key, **options)
        dropped = keep(found.filter(row != F.col("component_id.row")).select(row.alias("row")))
    return keyed.join(dropped, row == dropped["row"], "left_anti").select(*[col(c) for c in df.columns])
