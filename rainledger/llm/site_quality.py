"""Quality classifier: document evidence on hierarchical empirical-Bayes priors of sites.

**Evidence.** The statistics of a text are cut into bins at ranks of labelled rows. The sum of the
logarithmic ratios of the bin's frequency among good and bad rows, tempered because statistics are not
independent, is the document's evidence.

**Prior.** Labelled rows are counted per path, host and source, levels of one hierarchy below all rows.
The share of good rows of a group is drawn to that of the group above it, with the weight of so many
rows as the spread of the groups of this level suggests (method of moments). A site without labels has
its parent's share.

A labelled row is left out of the counts that judge it, of bins and of sites. Counts are grouped and mergeable;
those of sites return to the rows by joins with stored tables. The cut points come from at most about
``CUT_ROWS`` labelled rows, all of them if there are no more; the same rows give the same cut points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .columns import col
from .quality_rules import statistics
from .text_statistics import text_counts
from .url_rules import host_and_path

BINS = 16
#: Bound of the labelled rows whose ranks give the cut points; of more, a part is chosen by a hash of the row.
CUT_ROWS = 50_000
#: Weight of the sum of the statistics' evidence.
TEMPER = 0.5
#: A document is kept if its probability to be good is at least this.
THRESHOLD = 0.5
#: Bounds of the weight of a parent, in rows.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0


def site_levels(url: Column) -> list[Column]:
    """Host, and host with the first folder of the path; NULL without a host."""
    host, path = host_and_path(url)
    folder = F.regexp_extract(path, "^/[^/]*", 0)
    return [F.when(host != "", host), F.when(host != "", F.concat(host, folder))]


def classify(docs: DataFrame, labels: DataFrame, levels: Sequence[str], text: str = "text", *,
             sites: DataFrame | None = None, site_columns: Sequence[str] = (), id_column: str = "doc_id",
             quality: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, evidence, prior, probability, kept.

    ``levels``: columns of ``docs`` from the widest to the narrowest group, followed by ``site_columns``
    of ``sites``, a table by id (of several rows of one id the smallest values count). A NULL is a row
    outside of this and all narrower levels. ``labels``: 0 is bad, 1 is good, NULL is no label; of one id with
    several labels the lowest counts. A NULL or empty text is a text without words. Without labels every
    prior is one half and evidence is 0, so every row is kept. NULL and repeated ids are kept.
    """
    names = [f"level{i}" for i in range(len(levels) + len(site_columns))]
    known = labels.filter(col(quality).isin(0, 1)).groupBy(col(id_column).alias("id")) \
        .agg(F.min(col(quality).cast("int")).alias("good"))
    counted = docs.select(col(id_column).alias("id"), text_counts(col(text)).alias("counts"),
                          *[col(c).cast("string").alias(n) for c, n in zip(levels, names)])
    if sites is not None:  # after the texts became counts: no text is shuffled
        more = sites.groupBy(col(id_column).alias("id")).agg(
            *[F.min(col(c).cast("string")).alias(n) for c, n in zip(site_columns, names[len(levels):])])
        counted = stored(counted).join(more, "id", "left")
    stats = statistics(F.col("counts"))
    path = F.lit("")
    nested = []
    for n in names:  # a narrower group lies in its wider one, whatever its own name
        path = F.concat(path, F.lit("\x1f"), F.col(n))
        nested.append(path.alias(n))
    rows = stored(counted.select("id", *nested, *[v.alias(k) for k, v in stats.items()]).join(known, "id", "left"))
    evidence = _evidence(rows, list(stats))
    judged = stored(rows.select("id", "good", *names, evidence.alias("evidence")))
    total = judged.agg(F.sum("good").alias("g"), F.count("good").alias("n")).first()
    all_good, all_rows = total.g or 0, total.n or 0
    own = F.coalesce("good", F.lit(0))
    has = F.when(F.col("good").isNotNull(), 1).otherwise(0)
    prior = (F.lit(float(all_good)) - own + 1) / (F.lit(float(all_rows)) - has + 2)
    out = judged
    for n in names:
        # The parent's share is what the rows of the group would have without it.
        groups = stored(out.filter(F.col(n).isNotNull()).groupBy(n).agg(
            F.sum("good").alias(f"{n}_g"), F.count("good").alias(f"{n}_n"),
            F.avg(F.when(F.col("good").isNotNull(), prior)).alias(f"{n}_parent")))
        weight = _weight(groups, f"{n}_g", f"{n}_n", f"{n}_parent")
        groups = groups.drop(f"{n}_parent")
        out = stored(out.join(groups, n, "left"))
        good, size = F.coalesce(f"{n}_g", F.lit(0)) - own, F.coalesce(f"{n}_n", F.lit(0)) - has
        prior = F.when(F.col(n).isNull(), prior).otherwise((good + weight * prior) / (size + weight))
    odds = F.log(prior / (1 - prior)) + F.col("evidence")
    probability = 1 / (1 + F.exp(-odds))
    return out.select(F.col("id").alias(id_column), F.col("evidence"), prior.alias("prior"),
                      probability.alias("probability"), (probability >= threshold).alias("kept"))


def _weight(groups: DataFrame, good: str, size: str, parent: str) -> float:
    """Rows that the parent counts for, from how far groups' shares spread around their parents' beyond chance.

    For a Beta prior with mean m and weight w, the squared distance of a group's share from m is expected to
    be m * (1 - m) * (1 / n + (1 - 1 / n) / (w + 1)). Differences between parents are no spread of the level.
    """
    share, m = F.col(good) / F.col(size), F.col(parent)
    found = groups.filter((F.col(size) > 1) & (m > 0) & (m < 1)).agg(
        F.sum(F.col(size) * (share - m) * (share - m) / (m * (1 - m))).alias("spread"),
        F.sum(F.col(size)).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if not found.groups or found.n <= found.groups:
        return MAX_WEIGHT
    beyond = (found.spread - found.groups) / (found.n - found.groups)
    return MAX_WEIGHT if beyond <= 0 else min(MAX_WEIGHT, max(MIN_WEIGHT, 1 / beyond - 1))


def _left_out(table: Callable[[int, int], Column]) -> Column:
    """``table(good, bad)`` for the row's own label: what the counts hold of the row itself."""
    return F.when(F.col("good") == 1, table(1, 0)).when(F.col("good") == 0, table(0, 1)).otherwise(table(0, 0))


def _cut_points(labelled: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Values at the ranks that cut the labelled rows into ``BINS`` parts, without repetition."""
    rows, total = labelled.select("id", *names), labelled.count()
    if total > CUT_ROWS:
        parts = 1 << 40
        rows = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) < parts * CUT_ROWS // total)
    found = rows.drop("id").collect()
    cuts = {}
    for n in names:
        ordered = sorted(r[n] for r in found)
        cuts[n] = sorted({ordered[len(ordered) * i // BINS] for i in range(1, BINS)}) if ordered else []
    return cuts


def _evidence(rows: DataFrame, names: list[str]) -> Column:
    """The evidence of a row as an expression; counts of bins and the rows for cut points are collected."""
    labelled = rows.filter("good IS NOT NULL")
    cuts = _cut_points(labelled, names)

    def number(n: str) -> Column:
        if not cuts[n]:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[n]]), lambda c: c < F.col(n)))

    pairs = F.array(*[F.struct(F.lit(n).alias("s"), number(n).alias("b")) for n in names])
    counts = labelled.select("good", F.inline(pairs)).groupBy("s", "b").agg(
        F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("n")).collect()
    total = F.lit(0.0)
    for name in names:
        table = {r.b: (r.g, r.n) for r in counts if r.s == name}
        all_g, all_n = sum(g for g, _ in table.values()), sum(n for _, n in table.values())
        if not all_g or not all_n:
            continue
        bins = len(cuts[name]) + 1

        def ratios(own_g: int, own_n: int) -> Column:
            out = []
            for b in range(bins):
                g, n = table.get(b, (0, 0))
                # A bin without a row of this label is not looked up by one.
                g, n = max(0, g - own_g), max(0, n - own_n)
                out.append(F.lit(math.log((g + 1) / (all_g - own_g + bins) / ((n + 1) / (all_n - own_n + bins)))))
            return F.get(F.array(*out), number(name))

        total = total + _left_out(ratios)
    return F.lit(TEMPER) * total
