"""The registered queries of the corpus operators, each over the whole of its table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import (bpe, chat, fingerprint, language, lexical, neardup, packing, pii, resampling, rules, secret_scan, sql,
                           token_count, url_rules)
from spendlens.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, permutations=60)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_phrase_fingerprints, op3_language_id, op4_personal_data, op5_secrets, op6_chat_format,
        op7_token_counts, op8_near_duplicates, op9_packing, op10_bpe_round_trip, op11_url_filters, op12_importance_resampling,
        op13_lexical_search)}
#: The others are learned, hashed or tokenized, which SQL does not express; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op4_personal_data": sql.PERSONAL_DATA, "op5_secrets": sql.SECRETS, "op6_chat_format": chat.SQL,
    "op8_near_duplicates": sql.NEAR_DUPLICATES, "op11_url_filters": url_rules.SQL, "op12_importance_resampling": resampling.SQL,
    "op13_lexical_search": lexical.SQL,
}
