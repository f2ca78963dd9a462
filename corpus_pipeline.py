"""From raw documents to packed token sequences, in five stages.

Each stage gets the documents that its predecessor kept, as a table of their own, and drops others.

A NULL or empty text has no words and ends at the first stage. Documents without an id are judged like others,
but neither learned from nor preferred to one with an id. Of repeated rows one is left by the third stage.
Further columns, also those named like something a stage adds, pass through unchanged until the last stage,
whose columns are its own. Without labels only the fixed quality rules reject; where no text has a language no
language is known and nothing is left. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rainledger.llm.columns import table
from rainledger.llm.exact_dedup import without_duplicates
from rainledger.llm.language_id import identify
from rainledger.llm.packing import pack
from rainledger.llm.quality_rules import kept
from rainledger.llm.queries import vocabulary
from rainledger.llm.simhash import DISTANCE, WIDTH, without_near_duplicates
from rainledger.sinks.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return kept(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    found = identify(docs)
    return found.filter(found.columns[-1]).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return without_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 4 differing bits or fewer, of four-word shingles."""
    return without_near_duplicates(docs, width=WIDTH, distance=DISTANCE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_dedup),
          ("simhash_near_dedup", simhash_near_dedup), ("packing", packing)]

#: SQL expresses neither the learned stages nor fingerprints and tokens; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
