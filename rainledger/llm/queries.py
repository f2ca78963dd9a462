"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .collocations import collocations
from .columns import table
from .exact_dedup import exact_duplicates
from .language_id import held_out, identify
from .line_dedup import line_digests
from .packing import pack
from .pieces import piece_digests
from .prefix_trie import branched_trie
from .quality_rules import judge
from .sharding import place
from .simhash import near_duplicates
from .site_quality import classify, site_levels
from .token_files import token_round_trip
from .url_rules import judge_urls, rule_table

#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, URL_RULES))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 64 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("text_chars"))
    return place(docs, [f"shard-{i:03d}" for i in range(64)])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page of their own id have its host and first folder as levels below their source."""
    host, folder = site_levels(F.col("url"))
    sites = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), host.alias("host"), folder.alias("folder"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return classify(docs, table(spark, sf_dir, "labels"), ["source"], sites=sites, site_columns=["host", "folder"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branched_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
