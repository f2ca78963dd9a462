"""Quality rules: learned decision lists over text statistics.

Sequential covering. A rule is a conjunction of thresholds that describes bad documents. It grows by the
condition with the largest gain on two thirds of the labelled rows, is cut back to the conjunction that
does best on the other third, and the rows that it covers leave. If no part of a rule is precise enough, the
bad rows that it covers are set aside and covering goes on. The list ends when no condition covers enough of
the bad rows that are left. It becomes one ordered conditional Spark expression.

Statistics are Spark expressions over whole texts. The list is learned on the driver from the statistics of
at most about ``LEARN_ROWS`` labelled rows, all of them if there are no more; the same rows give the same
list, whatever the order of tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .columns import col, free_name
from .text_statistics import text_counts

#: Cut points per statistic.
BINS = 1024
#: Bound of the labelled rows that are learned from.
LEARN_ROWS = 50_000
#: A rule must be right on this part of the held-out rows that it covers, and cover so many of the others.
MIN_PRECISION = 0.9
MIN_COVER = 5
#: Fixed base rules: fewest words, and the percentage of words in repeated windows that is too many.
MIN_WORDS, MAX_REPEATED = 20, 30


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])


def statistics(c: Column) -> dict[str, Column]:
    """Ratios of the counts in the struct ``c``; 0 where the denominator is."""
    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))

    return {
        "words": c["n_words"].cast("double"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "duplicate_lines": per("n_dup_lines", "n_words"),
        "repeated_words": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
        "upper_case": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def test(self, values: dict[str, Column]) -> Column:
        value = values[self.statistic]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _matches(rule: Rule, values: dict[str, Column]) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.test(values)
    return found


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Gain of a condition that leaves p bad and n good rows of p0 and n0."""
    if not p or not p0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, bad: str, fold: str, names: list[str], *, max_rows: int = LEARN_ROWS) -> list[Rule]:
    """The ordered rules for rows whose column ``bad`` is 1.

    ``labelled`` is a stored table with the statistics ``names``, ``bad`` (0 or 1) and ``fold`` (0 and 1
    grow rules, 2 prunes them). Of more than about ``max_rows`` rows a part is learned from, chosen by a hash
    of the row. Without a bad or a good row the list is empty.
    """
    total = labelled.count()
    rows = labelled.select(F.col(bad).cast("int").alias("bad"), F.col(fold).cast("int").alias("fold"),
                           *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    if total > max_rows:
        parts = 1 << 40
        rows = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) < parts * max_rows // total)
    found = sorted(map(tuple, rows.collect()))  # so that nothing depends on the order of tasks
    is_bad, grows = [r[0] == 1 for r in found], [r[1] < 2 for r in found]
    values = {n: [r[i + 2] for r in found] for i, n in enumerate(names)}
    cuts = {n: _cuts(v) for n, v in values.items()}
    bins = {n: [bisect_left(cuts[n], x) for x in v] for n, v in values.items()}
    rules: list[Rule] = []
    left = list(range(len(found)))
    while grown := _grow([i for i in left if grows[i]], is_bad, bins, cuts):
        rule = _prune([i for i in left if not grows[i]], is_bad, values, grown)
        if rule:
            rules.append(rule)
            left = [i for i in left if not _holds(rule, values, i)]
        else:
            # Its bad rows lead nowhere; the good ones still show what other rules would cost.
            left = [i for i in left if not (is_bad[i] and _holds(grown, values, i))]
    return rules


def _cuts(values: list[float]) -> list[float]:
    """The values at the ranks that cut the sorted values into ``BINS`` parts, without repetition."""
    ordered = sorted(values)
    return sorted({ordered[len(ordered) * i // BINS] for i in range(1, BINS)}) if ordered else []


def _holds(rule: Rule, values: dict[str, list[float]], i: int) -> bool:
    return all((values[c.statistic][i] > c.threshold) == c.above for c in rule)


def _grow(rows: list[int], is_bad: list[bool], bins: dict[str, list[int]], cuts: dict[str, list[float]]) -> Rule:
    """The conjunction that the largest gains lead to; each condition makes it more precise, so this ends."""
    rule: Rule = ()
    while True:
        p0 = sum(is_bad[i] for i in rows)
        n0 = len(rows) - p0
        if not n0:  # nothing good is left to keep out
            return rule
        best, chosen, at = 0.0, None, 0
        for name, own in bins.items():
            table = Counter((own[i], is_bad[i]) for i in rows)
            p = n = 0
            for k, cut in enumerate(cuts[name]):
                p, n = p + table[k, True], n + table[k, False]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(a, b, p0, n0)
                    if a >= MIN_COVER and gain > best:
                        best, chosen, at = gain, Condition(name, above, cut), k
        if chosen is None:
            return rule
        rule += (chosen,)
        rows = [i for i in rows if (bins[chosen.statistic][i] > at) == chosen.above]


def _prune(rows: list[int], is_bad: list[bool], values: dict[str, list[float]], rule: Rule) -> Rule:
    """The beginning of the rule that is best on the rows; empty if none is precise enough."""
    best, chosen = 0.0, ()
    for k in range(1, len(rule) + 1):
        rows = [i for i in rows if _holds(rule[k - 1:k], values, i)]
        p = sum(is_bad[i] for i in rows)
        n = len(rows) - p
        if p and p / (p + n) >= MIN_PRECISION and (worth := (p - n) / (p + n) * math.log1p(p)) > best:
            best, chosen = worth, rule[:k]
    return chosen


def verdict(rules: list[Rule], c: Column) -> Column:
    """The number of the first rule that the document matches, from 1; NULL if none does."""
    values = statistics(c)
    number = F.lit(None).cast("int")
    if rules:
        number = F.when(_matches(rules[0], values), 1)
        for i, rule in enumerate(rules[1:], 2):
            number = number.when(_matches(rule, values), i)
    return number


def learn_from(counted: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """Rules from (id, counts) and the labels of some ids: 0 is bad, 1 is good, NULL is no label.

    Rows that the base rules reject teach nothing, as the list never sees them.
    """
    c = F.col("counts")
    known = labels.select(col(id_column).alias("id"), (1 - col(quality).cast("int")).alias("bad")).filter("bad IN (0, 1)")
    values = statistics(c)
    rows = counted.join(known, "id").filter(~base_failed(c)).select(
        "bad", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("fold"), *[v.alias(n) for n, v in values.items()])
    return learn(stored(rows), "bad", "fold", list(values))


def judge(df: DataFrame, labels: DataFrame, text: str = "text", *, id_column: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule.

    ``kept`` is false if the base rules reject the text (under 20 words, or over 30 % of the words in
    repeated windows) or a learned rule matches; ``rule`` is its number. A NULL or empty text has no
    words and is rejected. Without labels the list is empty and only the base rules reject. NULL and
    repeated ids are kept; labels of one id that differ all count.
    """
    counted = stored(df.select(col(id_column).alias("id"), text_counts(col(text)).alias("counts")))
    rules = learn_from(counted, labels, id_column=id_column)
    c = F.col("counts")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counted.select(
        F.col("id").alias(id_column), *[c[n].alias(n) for n in names], base_failed(c).alias("base_failed"),
        (~base_failed(c) & verdict(rules, c).isNull()).alias("kept"), verdict(rules, c).alias("rule"))


def kept(df: DataFrame, labels: DataFrame, text: str = "text", *, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that :func:`judge` keeps, with their columns as they are."""
    # Every text is counted once. The labels meet the counts, so no text is moved.
    name = free_name(df, "counts")
    counted = stored(df.select("*", text_counts(col(text)).alias(name)))
    rules = learn_from(counted.select(col(id_column).alias("id"), F.col(name).alias("counts")), labels, id_column=id_column)
    c = F.col(name)
    return counted.filter(~base_failed(c) & verdict(rules, c).isNull()).drop(name)
