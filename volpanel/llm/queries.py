"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from volpanel.llm import (
    conversation_repair, factor_classifier, fingerprint, hard_negatives, lm_score, mixing, ngram_join, packing, quality_rules, suffix_dedup,
    token_store, url_filter, wrapper_extract,
)
from volpanel.llm.common import table, vocabulary

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The rules that the URL query is asked to apply.
URL_RULES = (
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Hosts with one of these words, each a whole one between borders of letters and digits, serve listed pages.
LISTED_WORDS = tuple(f"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)" for word in ("ads", "adult", "bets", "casino", "pills", "spam"))


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[query.__name__] = query
    return query


@register
def op1_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@register
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@register
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.listed_by_host(pages, LISTED_WORDS))


@register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


@register
def op7_factor_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.main_text(table(spark, sf_dir, "pages"))


@register
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = mixing.weigh(table(spark, sf_dir, "documents"))
    return weighed.withColumn("probability", F.round("probability", 9))


@register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(conversations), conversations)


@register
def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.written_and_read(spark, table(spark, sf_dir, "documents"), vocabulary())


@register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), hard_negatives.moved_label(), F.col("id") % 100 == 0)
