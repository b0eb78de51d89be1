"""One registered query per operator, each over its whole table with the
operator's production parameters, and the DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (byte_bpe, chat_format, embedding_hnsw, html_extract, minhash, packing, periodic_runs, quality_rules, secrets, suffix_dedup,
               token_alignment, token_count, url_filter)
from .tables import table
from .url_filter import Rule

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return keep


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


# Conversation -7 of the contract, beside those of the table.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op4_chat_format")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(given.unionByName(extra)))


@register("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@register("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


# The contract's domain rules.
DOMAIN_RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
                Rule("allow", "com/fr/"), Rule("block", "com/de/")]
# Patterns for URLs that no domain rule fits.
PATTERN_RULES = [Rule("block", "^ref^x^"), Rule("block", "^blog^*^es^"), Rule("allow", "^blog^*^es^*^ref^"),
                 Rule("block", "^login^"), Rule("block", "^cart^checkout^"), Rule("block", "^utm_source="),
                 Rule("block", "^net^fr^*#top"), Rule("allow", "^net^fr^2*#top"), Rule("block", ".exe^")]


@register("op8_url_filter", url_filter.oracle(DOMAIN_RULES, PATTERN_RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), DOMAIN_RULES, PATTERN_RULES)


@register("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("votes")


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@register("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


@register("op1_embedding_hnsw")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


@register("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(table(spark, sf_dir, "documents"))


@register("op13_html_extraction")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))
