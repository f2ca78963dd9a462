"""Incremental intake of series documents from a landing directory.

Parsing and the row rules are stateless, so they run unchanged on a stream. Exact duplicates may
arrive in different runs; they are removed when the stored rows are read through
``clean_observations``, instead of keeping every row seen so far as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import DEFAULT, valid_observations
from ..schema import Rules
from ..sources.documents import documents_from, flatten_timeseries


def stream_observations(spark: SparkSession, landing: str, rules: Rules = DEFAULT, *,
                        max_files: int | None = None) -> DataFrame:
    """Valid observations of documents as they arrive, one document per file."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return valid_observations(flatten_timeseries(documents_from(reader.load(landing))), rules)


def ingest_available(spark: SparkSession, landing: str, target: str, progress: str,
                     rules: Rules = DEFAULT, *, max_files: int | None = None) -> StreamingQuery:
    """Append what is new in ``landing`` to the parquet table ``target``, then stop.

    ``progress`` is the stream's checkpoint directory: a run that dies is continued by the next
    one without loss or repetition.
    """
    rows = stream_observations(spark, landing, rules, max_files=max_files)
    return (rows.writeStream.format("parquet").outputMode("append").partitionBy(rules.year)
            .option("checkpointLocation", progress).trigger(availableNow=True).start(target))
