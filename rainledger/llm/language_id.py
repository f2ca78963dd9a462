"""Language identification by compression with one dictionary per language.

Training texts of a language are joined to a raw-content dictionary for zstandard. A text is compressed
with each dictionary, in chunks so short that the dictionary and not the text itself does most of the
work, and takes the language with the smallest sum. If the second smallest is hardly larger, the
prediction is rejected.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .columns import col, free_name

#: Bounds of the training sample per language: texts, and characters of all of them together.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 1 << 18
#: Languages that are learned, those with most rows; each task holds all dictionaries.
MAX_LANGUAGES = 256
#: Bytes compressed at once.
CHUNK = 4096
LEVEL = 6
#: Predictions are accepted if the second best size exceeds the best by this part of itself.
MIN_MARGIN = 0.01
UNKNOWN = "und"
#: Languages that a warning names at most.
NAMED = 20


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is never learned from; a NULL id counts as not held out, but is not learned from either."""
    return F.coalesce(F.crc32(col(id_column).cast("string")) % 3 == 1, F.lit(False))


def training_sample(df: DataFrame, text: str, label: str, id_column: str, *,
                    max_languages: int = MAX_LANGUAGES) -> list[tuple[str, str]]:
    """(language, text) of at most ``SAMPLE_TEXTS`` whole texts and ``SAMPLE_CHARS`` characters a language.

    Texts are dealt by a hash, and each hand gives its first: all rows take part, equal texts fill one hand,
    and equal tables give equal samples. Whole texts are taken until the characters are used up; only the
    last one is cut. Hashes are grouped; the chosen texts are fetched by a join. With more languages than
    ``max_languages`` those with the fewest rows are not learned, and a warning names them.
    """
    rows = df.select(col(label).cast("string").alias("label"), F.xxhash64(col(text)).alias("h"), F.length(col(text)).alias("chars"),
                     col(text).alias("text"), (F.crc32(col(id_column).cast("string")) % 3 != 1).alias("use")) \
        .filter("use AND label IS NOT NULL AND text <> ''")
    hands = stored(rows.groupBy("label", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("hand")).agg(
        F.min(F.struct("h", "chars")).alias("first"), F.count(F.lit(1)).alias("n")))
    sizes = hands.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "label")
    known = [r.label for r in sizes.limit(max_languages + NAMED).collect()]
    if len(known) > max_languages:
        warnings.warn(f"languages with fewer rows than the first {max_languages} are not learned: "
                      + ", ".join(known[max_languages:]) + " ...", stacklevel=3)
    order = Window.partitionBy("label").orderBy("first.h")  # at most SAMPLE_TEXTS rows each
    taken = (hands.filter(F.col("label").isin(known[:max_languages]))
             .withColumn("before", F.sum("first.chars").over(order) - F.col("first.chars")).filter(F.col("before") < SAMPLE_CHARS)
             .select("label", "first.h", "before"))
    cut = F.substring("text", F.lit(1), (F.lit(SAMPLE_CHARS) - F.col("before")).cast("int"))
    picked = rows.join(stored(taken), ["label", "h"]).groupBy("label", "h").agg(F.min(cut).alias("text"))
    return [(r.label, r.text) for r in picked.orderBy("label", "h").collect()]


def _plain(text: str) -> bytes:
    """Lower case, with each ASCII character that is no letter as a blank."""
    return text.lower().encode().translate(_BLANKED)


_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def dictionaries(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """Language to dictionary. The codec prefers what lies near its end; the order is that of the hashes."""
    parts: dict[str, list[bytes]] = {}
    for label, text in sample:
        parts.setdefault(label, []).append(b" ".join(_plain(text).split()))
    return {label: b" ".join(p) for label, p in sorted(parts.items()) if any(p)}


class Classifier:
    def __init__(self, known: dict[str, bytes]) -> None:
        import zstandard

        self.labels, self.compress = list(known), []
        for content in known.values():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the part by which the best size is below the second best."""
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = b" ".join(_plain(text).split())
        chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = [sum(len(c(x)) for x in chunks) for c in self.compress]
        if len(sizes) == 1:
            return self.labels[0], 1.0
        best, second = sorted(sizes)[:2]
        return self.labels[sizes.index(best)], 1 - best / second if second else 0.0


def identify(df: DataFrame, text: str = "text", *, label: str = "lang", id_column: str = "doc_id",
             train: DataFrame | None = None, min_margin: float = MIN_MARGIN,
             max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    Learns from text and label of rows of ``train`` (else ``df``) whose label is known and whose
    ``crc32(id as text) mod 3`` is not 1. A NULL text, one without a letter, or no training data at all
    gives ``und``, score 0, not accepted. Of more than ``max_languages`` languages those with most rows are
    learned. Of equal sizes the alphabetically first language wins. A column
    of ``df`` that has one of these names is kept, and the new one gets underscores before its name.
    """
    known = dictionaries(training_sample(df if train is None else train, text, label, id_column, max_languages=max_languages))
    shared = df.sparkSession.sparkContext.broadcast(known)  # max_languages * SAMPLE_CHARS characters at most
    names = [free_name(df, n) for n in ("lang_pred", "score", "accepted")]
    at = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            labels, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            accepted = pa.array([p != UNKNOWN and s >= min_margin for p, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, labels, scores, accepted], [*batch.schema.names, *names])

    from pyspark.sql import types as T

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType(df.schema.fields + [T.StructField(n, k) for n, k in zip(names, kinds)])
    return df.mapInArrow(run, schema)
