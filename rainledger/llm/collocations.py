"""Phrase collocations: windows of the longest length are counted, shorter phrases are sums of them.

**Top-order marginalisation.** Each word begins one window of ``longest`` words, itself and the words that
follow it in its piece, padded at the end of the piece. Only these windows are counted. ``ROLLUP`` over the
window's columns then sums them by successively shorter beginnings: the sum at a beginning without padding
is the number of occurrences of this phrase, at the first word that of the word, and at the language that of
all words. No phrase length but the longest is ever exploded.

**Padding early.** A phrase occurs no more often than any two adjacent words in it. So a window may also end
before a pair of words that is rarer than the least count of a candidate: no candidate and no part of one
loses an occurrence. Pairs are counted first, by hash; the hashes of frequent ones set bits of a bitmap of
fixed size, the only thing that is broadcast. A bit set by two pairs only lets windows be longer. Most
windows then are a single word, and these collapse before the shuffle.

**Scores** are integers: a product of up to 38 digits, divided without a remainder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored, working_tables
from .columns import col

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: A part that is as often inside a longer candidate as on its own, in percent, is no phrase of its own.
INSIDE = 100
#: Bits of the bitmap of frequent pairs: 16 MB, however many pairs there are.
BITS = 1 << 27
#: Bytes of text that a task works on at once, but for the rest of the last text; distinct words that it remembers.
CHUNK, REMEMBERED = 1 << 21, 1 << 18
#: What the top is taken from in a first step, so that a language with most candidates isn't sorted in one task.
SALTS = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


class _Ids(dict):
    """Word to number; an unknown word gets the next one. Nothing here refers back, so that all of it goes at once."""

    def __init__(self) -> None:
        from array import array

        from xxhash import xxh3_64_intdigest

        super().__init__({b"": -2, b"\n": -1})  # between blanks, between pieces
        self.texts, self.hashes, self.digest = [], array("Q"), xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.texts)
        self.texts.append(word)
        self.hashes.append(self.digest(word))
        return n


class _Words:
    """Numbers for words, as they occur, with their texts and hashes."""

    def __init__(self) -> None:
        self.ids = _Ids()
        self.texts: list[bytes] = self.ids.texts

    def numbers(self, texts: list[bytes]):
        """The words of the texts in order, with -1 between pieces."""
        import numpy as np

        ids, get = [], self.ids.__getitem__
        for t in texts:
            ids.extend(map(get, t.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")))
            ids.append(-1)
        found = np.array(ids, np.int64)
        return found[found > -2]

    def pair_hashes(self, lang: str, numbers):
        """A hash per word and the one after it; what pairs at a break have means nothing."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        h = np.array(self.ids.hashes, np.uint64)[numbers] if self.texts else np.zeros(len(numbers), np.uint64)
        h ^= h >> np.uint64(29)
        mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(xxh3_64_intdigest(lang))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))


def _chunks(batches: Iterator) -> Iterator:
    """(language, words, numbers) of parts of the texts, a language at a time; a text's pieces stay together.

    Each language holds less than ``CHUNK`` bytes and a text back.
    """
    import pyarrow as pa

    words, texts, sizes = _Words(), {}, {}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    texts.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text)
                    if sizes[lang] > CHUNK:
                        sizes[lang] = 0
                        yield lang, words, words.numbers(texts.pop(lang))
                        if len(words.texts) > REMEMBERED:
                            words = _Words()
    for lang, rest in texts.items():
        yield lang, words, words.numbers(rest)


def _pairs(batches: Iterator) -> Iterator:
    """(lang, text) to (hash, n) of adjacent words."""
    import numpy as np
    import pyarrow as pa

    for lang, words, numbers in _chunks(batches):
        inside = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        values, counts = np.unique(words.pair_hashes(lang, numbers)[inside], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])


def _windows(longest: int, bitmap):
    """(lang, text) to (lang, w1, ..., n): padded windows, '' is padding; equal ones of a chunk are one row."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(bitmap.value, np.uint8)
        for lang, words, numbers in _chunks(batches):
            if not words.texts:
                continue
            at = words.pair_hashes(lang, numbers) & np.uint64(BITS - 1)
            on = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            on = np.append((on == 1) & (numbers[:-1] >= 0) & (numbers[1:] >= 0), np.zeros(longest, bool))
            padded = np.append(numbers, np.full(longest, -1))
            starts = np.flatnonzero(numbers >= 0)
            columns, going = [padded[starts]], np.ones(len(starts), bool)
            for k in range(1, longest):
                going = going & on[starts + k - 1]
                columns.append(np.where(going, padded[starts + k], -1))
            alone = columns[1] < 0 if longest > 1 else np.ones(len(starts), bool)
            counts = np.bincount(columns[0][alone], minlength=1)
            singles = np.flatnonzero(counts)
            rest = np.stack([c[~alone] for c in columns])
            rest = rest[:, np.lexsort(rest[::-1])]
            new = np.flatnonzero(np.append(True, (rest[:, 1:] != rest[:, :-1]).any(axis=0))) if rest.shape[1] else np.zeros(0, np.int64)
            sums = np.append(counts[singles], np.diff(np.append(new, rest.shape[1])))
            texts = pa.array([*words.texts, b""], pa.binary()).cast(pa.string())
            out = [pa.array([lang]).take(pa.array(np.zeros(len(sums), np.int64)))]
            for k in range(longest):
                first = singles if k == 0 else np.full(len(singles), -1)
                ids = np.append(first, rest[k, new])
                out.append(texts.take(pa.array(np.where(ids < 0, len(words.texts), ids))))
            out.append(pa.array(sums.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(out, ["lang", *_names(longest), "n"])

    return run


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def _frequent_pairs(rows: DataFrame, least: int) -> bytes:
    """The bitmap of hashes of pairs that occur ``least`` times or more."""
    hashes = rows.mapInArrow(_pairs, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # Spark's bucket n holds the values from (n - 1) * 32768 + 1 to n * 32768, the lowest at its first bit.
    place = F.col("hash").bitwiseAND(F.lit(BITS - 1)) + 1
    # Places are dealt by their bucket before the buckets are built: a bucket of 4 KB is made once, not per task.
    dealt = hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).repartition("part")
    parts = dealt.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # BITS / 32768 rows of 4 KB at most
    found = bytearray(BITS // 8)
    for r in parts:
        found[(r.part - 1) * 4096:r.part * 4096] = r.bits
    return bytes(found)


def phrase_counts(df: DataFrame, text: str = "text", *, lang: str = "lang", longest: int = LONGEST,
                  min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, f): all phrases of up to ``longest`` words with f >= ``min_count``, and the total of each
    language, whose ``words`` is empty. Stored."""
    rows = df.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).alias("text"))
    bitmap = df.sparkSession.sparkContext.broadcast(_frequent_pairs(rows, min_count))
    names = _names(longest)
    fields = ", ".join(f"{n} string" for n in ("lang", *names))
    windows = rows.mapInArrow(_windows(longest, bitmap), f"{fields}, n bigint").groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # Of the grouping's bits, one is set per column that a row sums over; the columns left of them are its phrase.
    size = F.lit(longest) - F.bit_count("g")
    whole = F.slice(F.array(*names), 1, F.greatest(size, F.lit(0)))
    kept = summed.filter("lang IS NOT NULL").withColumn("size", size).filter(
        (F.col("size") == 0) | ((F.col("f") >= min_count) & (F.get(F.array(*names), F.col("size") - 1) != "")))
    return stored(kept.select("lang", whole.alias("words"), "f"))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(df: DataFrame, text: str = "text", *, lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
                 inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """Phrases of 2 to ``longest`` words by how much they go together: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces and those at blanks and
    tabs into words. Counts are per language; a NULL language is ``und``. n is the number of words, a that of
    the phrase (``min_count`` or more), l and r those of its two parts at the cut that scores lowest, of equal
    ones the first. The score is ``floor(1000 * a * n / (l * r))``. A phrase inside a longer candidate that
    has ``inside`` percent of its count or more is left out. Of each language the first ``top`` by score, then
    count, then phrase are returned, all if it is None. NULL and empty texts have no words; repeated rows
    count each time; an empty table gives an empty result. Other columns don't matter.
    """
    with working_tables(df.sparkSession) as keep:
        known = phrase_counts(df, text, lang=lang, longest=longest, min_count=min_count)
        return keep(_ranked(_scored(known, inside), top))


def _scored(known: DataFrame, inside: int) -> DataFrame:
    totals = stored(known.filter(F.size("words") == 0).select("lang", F.col("f").alias("n")))
    phrases = known.filter(F.size("words") > 0).select("lang", "words", _phrase(F.col("words")).alias("phrase"), "f")
    candidates = phrases.filter(F.size("words") > 1)
    m = F.size("words")
    places = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.transform(
        F.sequence(F.lit(1), m - k + 1), lambda i: F.slice("words", i, k))))
    parts = candidates.filter(m > 2).select("lang", F.explode(places).alias("part"), "f")
    longer = parts.groupBy("lang", _phrase(F.col("part")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = stored(candidates.join(longer, ["lang", "phrase"], "left")
                  .filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("f")))
                  .select("lang", "words", "phrase", F.col("f").alias("a")))
    cuts = left.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(
        _phrase(F.slice("words", F.lit(1), k)).alias("left"), _phrase(F.slice("words", k + 1, m - k)).alias("right")))).alias("k", "cut"))
    counted = (
        cuts.select("lang", "phrase", "a", "k", "cut.left", "cut.right")
        .join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang"))
    score = F.expr("(CAST(1000 * a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = counted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _ranked(scored: DataFrame, top: int | None) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:
        # A language's first are among the first of each of its parts.
        part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        within = Window.partitionBy("lang", "part").orderBy(*order)
        scored = scored.withColumn("part", part).withColumn("place", F.row_number().over(within)).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    found = scored.withColumn("rank", rank).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return found if top is None else found.filter(F.col("rank") <= top)
