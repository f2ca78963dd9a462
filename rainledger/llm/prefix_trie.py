"""Prefix trie of conversations: a z-fast trie, built by insertion in batches.

A conversation is a string of turns. The trie of all its prefixes is kept compacted: a node is where
conversations end or part, and an edge is the run of turns above it. Each prefix has a hash of 128 bits.

**Handles.** The edge from depth p (exclusive) to e (inclusive) is found under its two-fattest depth, the
number in (p, e] with the most binary zeros at its end, and the hash of the prefix of this depth.

**Fat binary search.** A conversation looks for its exit node in (low, high]: it looks up the two-fattest
depth of the interval with its own prefix hash. If an edge has this handle and its end is a prefix of the
conversation too, ``low`` becomes the end; if its end is no prefix, the conversation leaves within this edge;
if there is none, ``high`` becomes the depth before. So a conversation of n turns needs log(n) lookups,
which are joins of all conversations that are still to be placed with the table of edges. A last lookup
under the first turn below ``low`` finds an edge that is left before its handle.

**Batches.** Each round searches for all that is left. Edges that are left in the middle are split at all
these depths at once. Of the conversations that go on below one point with the same turn, one, chosen by a
hash, is inserted; the others find it in the next round and start there. A path of n nodes takes a
logarithmic number of rounds on average, as the chosen one is a random one.

**Figures of nodes.** Each node is paired with all nodes above it by doubling the length of the jumps to
parents. The pairs, at most twice as many as there are turns, are summed by the upper node. Then edges are
expanded into one row per depth.

Groups are minima, sums and counts that are combined before the shuffle, so a turn with which a third of all
conversations begin costs no more than others. Copies of a conversation are one row after the first
grouping. A conversation's turns are one row of hashes, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored, working_tables
from .columns import SPACES, col, let

#: Below the root: depth, hash and words of the empty prefix.
ROOT = "named_struct('a', 0L, 'b', 0L, 'words', 0L)"


def turns(df: DataFrame, *, id_column: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(conv, pos, h0, h1, words): the turns of each conversation in order, from position 1, without their texts.

    NULL turns come first. Turns of the same number are ordered by role and then by a hash. NULL role and
    text count as empty. Rows without a conversation are left out. Repeated rows are turns of their own.
    """
    who, said = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    count = F.size(F.filter(F.split(said, f"[{SPACES}]+"), lambda w: w != "")).cast("long")
    rows = df.filter(col(id_column).isNotNull()).select(
        col(id_column).alias("conv"), col(turn).alias("turn"), who.alias("role"),
        F.xxhash64(who, said).alias("h0"), F.xxhash64(F.lit(1), who, said).alias("h1"), count.alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "h0", "h1")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "h0", "h1", "words")


def sequences(ordered: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, path): each conversation of ``convs`` with an entry per depth: hash of the prefix, words so far.

    ``ordered``: (conv, pos, h0, h1, words), where ``pos`` only has to be in order. A turn's hash takes its
    depth in, and the hash of a prefix is the exclusive or of its turns' hashes.
    """
    order = Window.partitionBy("conv").orderBy("pos")
    numbered = ordered.withColumn("depth", F.row_number().over(order).cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    paths = numbered.select(
        "conv", "depth", F.bit_xor(F.xxhash64("depth", "h0", "h1")).over(running).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "depth", "h1", "h0")).over(running).alias("b"), F.sum("words").over(running).alias("words"))
    joined = paths.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("path"))
    entries = F.transform("path", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words")))
    return convs.join(joined.select("conv", entries.alias("path")), "conv", "left").select(
        "conv", F.coalesce("path", F.expr(f"slice(array({ROOT}), 1, 0)")).alias("path"))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most zeros at its end; low < high."""
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1))


def _keyed(edges: DataFrame) -> DataFrame:
    """Edges (p, above, edge) with what they are found under.

    ``above`` is the entry at depth p, ``edge`` those from p + 1 to e. ``f``: depth of the handle; ``handle``,
    ``first``, ``end``: the entries at the handle, at p + 1 and at e.
    """
    e = F.col("p") + F.size("edge")
    return edges.select("p", "above", "edge", e.alias("e"), fattest(F.col("p"), e).alias("f")).select(
        "*", F.get("edge", F.col("f") - F.col("p") - 1).alias("handle"), F.get("edge", F.lit(0)).alias("first"),
        F.get("edge", F.size("edge") - 1).alias("end"))


def _alike(x: Column, y: Column) -> Column:
    return (x["a"] == y["a"]) & (x["b"] == y["b"])


def _shared(path: Column, p: Column, edge: Column) -> Column:
    """How many entries of an edge below depth p are prefixes of the path; after a difference all differ."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size(edge) - 1),
                           lambda k: F.coalesce(_alike(F.get(path, p + k), F.get(edge, k)), F.lit(False))))


def located(left: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """Where each conversation (path, low) leaves the trie: (path, low, depth, p).

    ``low`` is the end of the last edge that is a prefix of it, ``depth`` the longest prefix that the trie
    has. ``p`` is where the edge that it leaves in the middle begins, NULL if it leaves at ``low``. The two
    keys of an edge are unique, so no lookup makes more rows.
    """
    size = F.size("path")
    found = left.select("path", "low", size.alias("high"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("depth"))
    by_handle = edges.select(F.col("f").alias("ef"), F.col("handle.a").alias("ea"), F.col("handle.b").alias("eb"),
                             F.col("p").alias("ep"), F.col("e").alias("ee"), "end", "edge")
    for _ in range(steps):
        asked = found.withColumn("f", F.when(F.col("low") < F.col("high"), fattest(F.col("low"), F.col("high"))))
        entry = F.get("path", F.col("f") - 1)
        asked = asked.withColumns({"fa": entry["a"], "fb": entry["b"]})
        hit = asked.join(by_handle, (F.col("f") == F.col("ef")) & (F.col("fa") == F.col("ea")) & (F.col("fb") == F.col("eb")), "left")
        whole = F.coalesce(_alike(F.get("path", F.col("ee") - 1), F.col("end")), F.lit(False))
        known, through = F.col("ee").isNotNull(), F.col("ee").isNotNull() & whole
        inside = known & ~whole
        found = hit.select(
            "path", F.when(through, F.col("ee")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("f").isNull() | through, F.col("high")).when(inside, F.col("low")).otherwise(F.col("f") - 1).alias("high"),
            F.when(inside, F.col("ep")).otherwise(F.col("p")).alias("p"),
            F.when(inside, F.col("ep") + _shared(F.col("path"), F.col("ep"), F.col("edge"))).otherwise(F.col("depth")).alias("depth"))
    first = F.when(F.col("p").isNull(), F.get("path", F.col("low")))
    below = edges.select(F.col("p").alias("ep"), F.col("first.a").alias("ea"), F.col("first.b").alias("eb"), "edge")
    asked = found.withColumns({"fa": first["a"], "fb": first["b"]})
    hit = asked.join(below, (F.col("low") == F.col("ep")) & (F.col("fa") == F.col("ea")) & (F.col("fb") == F.col("eb")), "left")
    inside = F.col("ep").isNotNull()
    return hit.select(
        "path", "low", F.when(inside, F.col("ep")).otherwise(F.col("p")).alias("p"),
        F.when(inside, F.col("ep") + _shared(F.col("path"), F.col("ep"), F.col("edge")))
        .otherwise(F.coalesce("depth", "low")).alias("depth"))


def build(paths: DataFrame) -> DataFrame:
    """The compacted trie of distinct, stored (path): edges with their keys, stored."""
    left = paths.filter(F.size("path") > 0).select("path", F.lit(0).alias("low"))
    edges = stored(_keyed(left.limit(0).select(F.lit(0).alias("p"), F.expr(ROOT).alias("above"), F.col("path").alias("edge"))))
    longest = left.agg(F.max(F.size("path"))).first()[0] or 0
    while longest:
        with working_tables(paths.sparkSession) as keep:
            at = stored(located(left, edges, longest.bit_length()))
            edges = keep(_keyed(_split(edges, at).unionByName(_added(at))))
            # The end of a chosen conversation is found in the next round.
            left = keep(at.filter(F.size("path") > F.col("depth")).select("path", F.col("depth").alias("low")))
        longest = left.agg(F.max(F.size("path") - F.col("low"))).first()[0] or 0
    return edges


def _split(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(p, above, edge) after edges were cut at all depths at which a conversation leaves them."""
    first = F.get("path", F.col("p"))
    cuts = at.filter("p IS NOT NULL").groupBy(F.col("p").alias("cp"), first["a"].alias("ca"), first["b"].alias("cb")) \
        .agg(F.collect_set("depth").alias("cuts"))
    both = edges.join(cuts, (F.col("p") == F.col("cp")) & (F.col("first.a") == F.col("ca")) & (F.col("first.b") == F.col("cb")), "left")
    inner = F.filter(F.coalesce("cuts", F.expr("array()").cast("array<int>")), lambda d: d < F.col("e"))
    starts = F.array_sort(F.array_union(F.array("p"), inner))
    parts = let(starts, lambda s: F.transform(s, lambda d, i: F.struct(
        d.alias("p"), F.when(d == F.col("p"), F.col("above")).otherwise(F.get("edge", d - F.col("p") - 1)).alias("above"),
        F.slice("edge", d - F.col("p") + 1, F.coalesce(F.get(s, i + 1), F.col("e")) - d).alias("edge"))))
    return both.select(F.inline(parts))


def _added(at: DataFrame) -> DataFrame:
    """(p, above, edge): one new leaf for each turn with which conversations go on below one point."""
    first = F.get("path", F.col("depth"))
    chosen = at.filter(F.size("path") > F.col("depth")).groupBy("depth", first["a"].alias("na"), first["b"].alias("nb")).agg(
        F.min_by("path", F.struct(F.xxhash64(F.get("path", F.size("path") - 1)), F.size("path"))).alias("path"))
    above = F.when(F.col("depth") == 0, F.expr(ROOT)).otherwise(F.get("path", F.col("depth") - 1))
    return chosen.select(F.col("depth").alias("p"), above.alias("above"),
                         F.slice("path", F.col("depth") + 1, F.size("path") - F.col("depth")).alias("edge"))


def _ancestors(nodes: DataFrame) -> DataFrame:
    """(node, up): every node with each node above it but the root; nodes are (depth, a, b)."""
    jump = stored(nodes.filter("parent.depth > 0").select("node", F.col("parent").alias("up")))
    pairs, found = jump, [jump]
    while not jump.isEmpty():
        ahead = jump.select(F.col("node").alias("up"), F.col("up").alias("further"))
        more = stored(pairs.join(ahead, "up").select("node", F.col("further").alias("up")))
        jump = stored(jump.join(ahead, "up").select("node", F.col("further").alias("up")))
        found.append(more)
        pairs = pairs.unionByName(more)
    return pairs


def _sha_of_ends(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the ascending decimal ids of each node, joined by commas.

    The ids of a node are sorted in the shuffle and read as a stream: a task holds the state of one hash,
    never the ids of a node.
    """
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            out = []
            for depth, a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, a, b), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest())))], schema)

    import pyarrow as pa

    names = ["depth", "a", "b", "sha"]
    schema = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])
    flat = ends.select("node.depth", "node.a", "node.b", "conv")
    found = flat.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "conv") \
        .mapInArrow(run, "depth int, a bigint, b bigint, sha string")
    return found.select(F.struct("depth", "a", "b").alias("node"), "sha")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of all prefixes of (conv, path), with the columns that :func:`prefix_trie` names."""
    with working_tables(paths.sparkSession) as keep:
        return keep(_trie_nodes(stored(paths)))


def _trie_nodes(paths: DataFrame) -> DataFrame:
    last = F.get("path", F.size("path") - 1)
    node = F.struct(F.size("path").alias("depth"), F.coalesce(last["a"], F.lit(0)).alias("a"), F.coalesce(last["b"], F.lit(0)).alias("b"))
    ends = stored(paths.select(node.alias("node"), "conv", "path"))
    distinct = stored(ends.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.min("conv").alias("own_first"),
                                               F.first("path").alias("path")))
    edges = build(distinct)

    def at(depth: str, entry: str) -> Column:
        return F.struct(F.col(depth).cast("int").alias("depth"), F.col(f"{entry}.a").alias("a"), F.col(f"{entry}.b").alias("b"))

    nodes = stored(edges.select(at("e", "end").alias("node"), at("p", "above").alias("parent"), "p", "e", "above", "edge"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    own = stored(nodes.select("node", "parent", (F.col("edge")[F.size("edge") - 1]["words"] - F.col("above.words")).alias("words"))
                 .join(children, "node", "left").join(distinct.select("node", "own", "own_first"), "node", "left")
                 .select("node", "parent", "words", "own_first", F.coalesce("own", F.lit(0)).alias("own"),
                         F.coalesce("children", F.lit(0)).alias("children")))
    above = _ancestors(own)
    pairs = above.unionByName(own.select("node", F.col("node").alias("up")))
    sums = stored(pairs.join(own.select("node", "own", "own_first", "children"), "node").groupBy(F.col("up").alias("node")).agg(
        F.sum("own").alias("n"), F.min("own_first").alias("first"), F.sum(F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves")))
    saved = stored(sums.join(own.select("node", "words"), "node").select("node", ((F.col("n") - 1) * F.col("words")).alias("saved")))
    below = above.join(saved, "node").groupBy(F.col("up").alias("node")).agg(F.sum("saved").alias("below"))
    sha = _sha_of_ends(ends)
    figures = stored(own.select("node", "children").join(sums, "node").join(below, "node", "left").join(sha, "node", "left"))
    upper = figures.select(F.col("node").alias("parent"), F.col("first").alias("parent_first"))
    totals = ends.agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n")).first()
    root_first = F.lit(totals["first"]).cast(paths.schema["conv"].dataType)
    wide = nodes.join(figures, "node").join(upper, "parent", "left")
    nothing = F.sha2(F.lit(""), 256)
    i = F.col("i")
    expanded = wide.select("*", F.posexplode("edge").alias("i", "x")).select(
        F.col("first").alias("conv_id"), (F.col("p") + i + 1).cast("long").alias("depth"),
        F.when(i > 0, F.col("first")).when(F.col("p") == 0, root_first).otherwise(F.col("parent_first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("p") + i + 1 < F.col("e"), F.lit(1)).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.get("edge", F.size("edge") - 1)["words"] - F.when(i == 0, F.col("above.words"))
                             .otherwise(F.get("edge", i - 1)["words"])) + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.when(F.col("p") + i + 1 == F.col("e"), F.coalesce("sha", nothing)).otherwise(nothing).alias("ends_sha256"))
    at_root = sha.filter("node.depth = 0").first()
    root = own.join(saved, "node").agg(
        F.sum(F.when(F.col("parent.depth") == 0, 1).otherwise(0)).alias("children"),
        F.sum(F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves"), F.sum("saved").alias("saved")).select(
        root_first.alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast(paths.schema["conv"].dataType).alias("parent_conv_id"),
        F.lit(totals["n"]).alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        (F.lit(at_root["sha"]) if at_root else nothing).alias("ends_sha256")).filter(F.col("n_convs") > 0)
    whole = expanded.unionByName(root)
    counts = ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return whole.select(*[F.col(c).cast("long").alias(c) if c in counts else c for c in whole.columns])


def prefix_trie(df: DataFrame, *, id_column: str = "conv_id", **columns) -> DataFrame:
    """A row per distinct sequence of first turns (role, text) of the conversations in ``df``, and the root.

    conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id; NULL at the root), n_convs
    (members: conversations that begin with the sequence), n_children, n_leaves (nodes without children in its
    subtree, itself included), saved_tokens (over its subtree: members beyond the first, times the words of
    the node's last text), ends_sha256 (of the ids of members that end here, ascending, joined by commas).

    What :func:`turns` says of NULLs, ties and repeated rows holds. An empty table gives an empty result.
    """
    ordered = turns(df, id_column=id_column, **columns)
    with working_tables(df.sparkSession) as keep:
        paths = keep(sequences(ordered, ordered.select("conv").distinct()))
    return trie_nodes(paths)


def with_branches(ordered: DataFrame, *, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, as a table of turns and one of ids.

    Conversation c takes the first h turns of conversation ``c - c % family`` in place of its own first h,
    with ``h = crc32(c) % most``; all if there are fewer, none if there is no such conversation. One that
    loses all its turns stays as an id.
    """
    convs = ordered.select("conv").distinct().select(
        "conv", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    own = ordered.join(convs.select("conv", "h"), "conv").filter(F.col("pos") > F.col("h"))
    heads = ordered.filter((F.col("pos") < most) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    taken = convs.join(heads, "base").filter(F.col("pos") <= F.col("h"))
    columns = ("conv", "pos", "h0", "h1", "words")
    # A head's positions end where those of its own turns begin.
    return own.select(*columns).unionByName(taken.select(*columns)), convs.select("conv")


def branched_trie(df: DataFrame, *, id_column: str = "conv_id", family: int = 20, most: int = 4, **columns) -> DataFrame:
    """:func:`prefix_trie` of the conversations that :func:`with_branches` rebuilds."""
    with working_tables(df.sparkSession) as keep:
        ordered = stored(turns(df, id_column=id_column, **columns))
        paths = keep(sequences(*with_branches(ordered, family=family, most=most)))
    return trie_nodes(paths)
