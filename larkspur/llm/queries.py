"""The ten operators as queries over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, decontaminate, jaccard, lm, pii, quality, sharding, tokencount, urls
from larkspur.llm.common import table
from larkspur.llm.sql import ORACLES

#: Where all machines find the vocabulary files.
VOCABULARIES = os.environ.get("LARKSPUR_TOKENIZERS", "/opt/tokenizers")
#: The host rules that the query's contract names.
HOST_RULES = [
    urls.host_rule("org/", "allow"),
    urls.host_rule("example.org/es/", "block"),
    urls.host_rule("example.org/en/1", "block"),
    urls.host_rule("com/fr/", "allow"),
    urls.host_rule("com/de/", "block"),
]
PATTERN_RULES = [
    urls.pattern_rule(p)
    for p in ["||spam-farm.", "||cheap-pills.", "||casino-win.", "||free-bets.", "||ads-track.", "||adult-x.", "/adserver/", "/casino/", "/viagra^", "/affiliate-*-offers/", "|ads.*/banner."]
] + [urls.pattern_rule("/casino/history/", "allow")]


def vocabulary(name: str) -> str:
    return f"{VOCABULARIES}/{name}"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, HOST_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_revisions(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary("byte_bpe_50k.tiktoken"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *sharding.OUT)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen: each conversation; rejected: the same with its last answer cut in half."""
    return chat.format_pairs(chat.against_cut_answers(chat.gather(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filters, op2_pii, op3_lm_scoring, op4_quality_rules, op5_decontamination, op6_bpe, op7_token_counts, op8_sharding, op9_jaccard_join, op10_chat_formatting]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
