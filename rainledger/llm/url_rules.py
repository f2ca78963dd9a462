"""URL filters: allow and block rules by host and path, applied by a sort-merge range join.

A rule fits its host and all subdomains if the path begins with the rule's path; the longest rule wins.
The canonical key of a rule is its host with the labels reversed, an end mark and its path. All keys that
begin with it are one interval, and two such intervals are nested or apart. A URL has a key for each
number of host labels that a rule has: the last so many labels reversed, the mark and its path. So "fits"
is "the key lies in the interval" for one of the URL's keys.

A sweep over the sorted keys and interval ends answers this. It carries the stack of open intervals: at
a beginning the stack is that of the rule with all rules around it, at an end that of the rules around
it. What a URL needs is the stack at the last end before its key. The top of the stack is the longest
rule among those of the key; the longest of the URL's keys wins.

On the cluster each distinct (host, path) is swept once. The key range is cut into parts at keys of a
bounded sample, which decides about balance only. An interval is copied to each part that it meets, so
every part is swept on its own. Results return to the rows by a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .columns import col, free_name

#: Ends the host in a key; it sorts before dots and letters, and no host or path has it.
MARK = "#"
#: Keys in the sample, and bytes of each, that cut the range into parts.
SAMPLE, SAMPLE_BYTES = 4096, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to
    ``?``, ``#`` or the end. NULL or no ``://``: both empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = F.regexp_extract(url, parts, 1), F.regexp_extract(url, parts, 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _key(host_labels: Column, path: Column) -> Column:
    return F.encode(F.concat(_reversed(host_labels), F.lit(MARK), path), "UTF-8")


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows; of equal host and path the block rule stays."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", *, id_column: str = "page_id",
               default: str = "allow", parts: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    ``rules``: (host, path, verdict); ``rule`` is its host and path. Length is that of host and path
    together; of equally long rules that fit, the one with the longer host wins. Of repeated rules with
    different verdicts the larger word (``block``) wins. Rows without a fitting rule, a NULL URL among
    them, have a NULL rule and the ``default`` verdict. A rule with an empty host fits hosts that are empty
    or end with a dot.
    NULL and repeated ids are kept.
    """
    host, path = host_and_path(col(url))
    pages = df.select(col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    wanted = pages.select("host", "path").distinct()
    stacks = _rule_stacks(rules)
    counts = sorted(r.n for r in stacks.select(F.size("labels").alias("n")).distinct().collect())
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = F.split("host", r"\.")
    keys = wanted.select("host", "path", labels.alias("labels")).select("host", "path", F.explode(F.filter(
        F.array(*[F.when(F.size("labels") >= n, _key(F.slice("labels", -n, n), F.col("path"))) for n in counts])
        if counts else F.array().cast("array<binary>"), lambda k: k.isNotNull())).alias("key"))
    keys = stored(keys)
    cuts = _cuts(keys, parts)

    def part(key: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= key))

    begin = stacks.select("key", F.concat("key", F.lit(b"\xff")).alias("end"), "stack", "around")
    nothing = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = (
        begin.select(F.explode(F.sequence(part(F.col("key")), part(F.col("end")))).alias("part"),
                     F.inline(F.array(F.struct(F.col("key").alias("at"), F.lit(0).alias("kind"), F.col("stack")),
                                      F.struct(F.col("end").alias("at"), F.lit(2).alias("kind"), F.col("around").alias("stack")))))
        .withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
        .unionByName(keys.select(part(F.col("key")).alias("part"), F.col("key").alias("at"), F.lit(1).alias("kind"),
                                 nothing.alias("stack"), "host", "path")))
    sweep = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.try_element_at(F.last("stack", ignorenulls=True).over(sweep), F.lit(-1))
    best = stored(
        events.withColumn("top", top).filter("kind = 1 AND top IS NOT NULL")
        .groupBy("host", "path").agg(F.max("top").alias("top")))
    return pages.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_column), "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, labels, stack, around): each rule with the rules whose interval holds its own, longest last.

    The rules around a rule have its host and a beginning of its path, so each path is cut to all its
    lengths and met with the rules by equality.
    """
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = rules.filter("host IS NOT NULL AND verdict IS NOT NULL").select(
        lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict") \
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    one = stored(one)
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                     F.concat("host", "path").alias("rule"), F.col("verdict"))
    outer = one.select("host", F.col("path").alias("beginning"), entry.alias("entry"))
    inner = one.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("beginning"))
    labels = F.split("host", r"\.")
    return stored(
        inner.join(outer, ["host", "beginning"]).groupBy("host", "path")
        .agg(F.array_sort(F.collect_list("entry")).alias("stack"))
        .select(_key(labels, F.col("path")).alias("key"), labels.alias("labels"), "stack",
                F.slice("stack", F.lit(1), F.size("stack") - 1).alias("around")))


def _cuts(keys: DataFrame, parts: int) -> Column:
    """Keys that cut the range into about ``parts`` equally filled parts, as a sorted array."""
    cut = F.substring(F.col("key"), 1, SAMPLE_BYTES)
    sample = sorted(bytes(r.k) for r in keys.orderBy(F.xxhash64("key")).limit(SAMPLE).select(cut.alias("k")).collect())
    picked = sorted({sample[i * len(sample) // parts] for i in range(1, parts)} if sample else set())
    return F.array(*[F.lit(k) for k in picked]) if picked else F.array().cast("array<binary>")


def kept_pages(df: DataFrame, rules: DataFrame, url: str = "url", **options) -> DataFrame:
    """The rows of ``df`` whose URL is allowed, with all their columns."""
    row = free_name(df, "row")
    marked = stored(df.withColumn(row, F.monotonically_increasing_id()))  # both readings see the same numbers
    allowed = judge_urls(marked, rules, url, id_column=row, **options).filter("verdict = 'allow'")
    return marked.join(allowed.select(row), row, "left_semi").drop(row)
