"""Counts over the words and lines of whole texts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import SPACES, let

#: Words in a window that counts as repeated.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that are found twice or more in the text, first ones included.

    Windows are hashed first. Texts whose hashes are all distinct, nearly all texts, have no repeated
    window. For others the windows whose hash is not unique are compared as text.
    """
    def hashes(ws: Column) -> Column:
        windows = F.sequence(F.lit(1), F.size(ws) - width + 1)
        return let(F.transform(ws, lambda w: F.xxhash64(w)),
                   lambda hs: F.transform(windows, lambda i: F.xxhash64(F.slice(hs, i, width))))

    def twice(sorted_pairs: Column) -> Column:
        """Positions of (value, position) pairs, sorted, whose value a neighbour has too."""
        n = F.size(sorted_pairs)
        near = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (
            F.get(sorted_pairs, k)["v"].eqNullSafe(F.get(sorted_pairs, k - 1)["v"])
            | F.get(sorted_pairs, k)["v"].eqNullSafe(F.get(sorted_pairs, k + 1)["v"])))
        return F.transform(near, lambda k: F.get(sorted_pairs, k)["i"])

    def pairs(values: Column) -> Column:
        return F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i"))))

    def exact(ws: Column, hs: Column) -> Column:
        found = let(pairs(hs), twice)
        texts = let(found, lambda at: F.array_sort(F.transform(
            at, lambda i: F.struct(F.array_join(F.slice(ws, i, width), " ").alias("v"), i.alias("i")))))
        starts = F.array_sort(let(texts, lambda t: F.when(F.size(t) > 0, twice(t)).otherwise(F.array().cast("array<int>"))))
        return let(starts, covered)

    def covered(starts: Column) -> Column:
        """Words below windows that begin at the sorted ``starts``."""
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct((s + width).alias("end"), (acc["n"] + F.least(F.lit(width), s + width - acc["end"])).alias("n")),
            lambda acc: acc["n"])

    return F.when(F.size(tokens) < width, F.lit(0)).otherwise(
        let(tokens, lambda ws: let(hashes(ws), lambda hs: F.when(
            F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(exact(ws, hs))))).cast("long")


#: Names of the counts that :func:`text_counts` gives.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines")


def text_counts(text: Column) -> Column:
    """A struct of BIGINT counts of a whole text; a NULL or empty text has zeros."""
    whole = F.coalesce(text, F.lit(""))

    def of(characters: str) -> Column:
        """How many characters are in the class; runs of them are taken out at once."""
        return F.length(whole) - F.length(F.regexp_replace(whole, f"[{characters}]+", ""))

    def counts(ws: Column) -> Column:
        n = {
            "n_words": F.size(ws), "word_chars": F.length(F.array_join(ws, "")), "n_symbols": of(SYMBOLS),
            "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(ws),
            "n_upper": of("A-Z"), "n_digits": of("0-9"), "n_lines": F.size(F.split(whole, "\n")),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in n.items()])

    return let(words(text), counts)

