"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import language, licenses, merkle, orderminhash, packing, periods, privacy, quality, recompression, sentencepiece, simhash, tokens, urls
from textloom.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Key of the registered queries' surrogates; a real run takes its own from a secret store.
SURROGATE_KEY = b"textloom registered queries"
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.edit_probe(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, count_out="n_replaced")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable."""
    return {f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_order_minhash, op4_url_filter, op5_simhash_near_dedup, op6_token_counts, op7_language_id, op8_quality_rules, op9_license_scan, op10_pii_surrogates, op11_periodic_runs, op12_merkle_manifest, op13_recompression_dedup)}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {"op4_url_filter": urls.oracle(), "op9_license_scan": licenses.oracle(), "op11_periodic_runs": periods.oracle(), "op12_merkle_manifest": merkle.oracle(), "op13_recompression_dedup": recompression.oracle()}
