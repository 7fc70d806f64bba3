"""A training corpus in five stages: quality rules, language, near-duplicates, personal data, packing.

Each stage takes what the one before it kept, read back from parquet, and all
but the last return the columns of ``documents``. Null ids and texts, repeated
rows and extra columns are kept as the stages' operators say; an empty table
gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import language, nearcopies, packing, privacy, quality
from textloom.llm.common import bounded_batches, stash, table
from textloom.llm.registry import BYTE_VOCABULARY, PIECE_MODEL, SURROGATE_KEY
from textloom.storage import drop_stash, scratch

#: Where a run's own key for surrogates is set; without it that of the registered queries is taken.
KEY_SETTING = "spark.textloom.surrogates.key"

#: Fertility, profiles, shingle sets, surrogates and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded_batches(spark)
    return quality.keep_good(docs, PIECE_MODEL)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has taught."""
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: five-word shingles of similarity 0.8 or more, verified on whole sets."""
    return nearcopies.first_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    from pyspark.sql import functions as F

    key = spark.conf.get(KEY_SETTING, "").encode() or SURROGATE_KEY
    return privacy.pseudonymise(docs, key).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of permitted sequence lengths over the documents' tokens."""
    return packing.pack_texts(docs, BYTE_VOCABULARY)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-duplicates", near_dedup), ("PII", pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again. What a stage no longer needs is deleted, texts before surrogates above all."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs = stash(stage(spark, docs, sf_dir), "stage")
            keep.append(docs)
        if k:
            drop_stash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
