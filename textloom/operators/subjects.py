"""Vault entries and registers: find and export a subject, what is indexed, knowledge objects with revisions, risks beside rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that count as personal whatever found them. Fixed values.
CORE_CATEGORIES = ("person", "email", "phone", "iban", "nir", "address")

#: Severities of a risk, the worst first. Fixed values.
SEVERITIES = ("critical", "high", "medium", "low")


def find_subject(vault: DataFrame, reference: str) -> DataFrame:
    """Vault entries (token, category, original) whose original holds the reference, case and outer blanks apart; an empty reference finds none."""
    wanted = reference.strip().lower()
    return vault.filter(F.lower("original").contains(wanted) if wanted else F.lit(False))


def export_subject(found: DataFrame) -> DataFrame:
    """One JSON line for each entry, its fields in order of name."""
    return found.select(F.to_json(F.struct(*sorted(found.columns))).alias("line"))


def vault_stats(vault: DataFrame) -> DataFrame:
    """Entries of each category."""
    return vault.groupBy("category").agg(F.count(F.lit(1)).alias("entries"))


def is_personal(source: Column, category: Column, labels: list[str]) -> Column:
    """Found by a pattern, of a core category, or of a known private label."""
    return F.coalesce((source == "pattern") | F.lower(category).isin(*CORE_CATEGORIES, *(x.lower() for x in labels)), F.lit(False))


def indexed_folders(chunks: DataFrame, path: str = "folder_path") -> DataFrame:
    """Distinct folders, in order."""
    return chunks.select(path).filter(F.col(path).isNotNull()).distinct().orderBy(path)


def chunk_count(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks there are."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"))


def commit_objects(objects: DataFrame, parts: DataFrame, new_objects: DataFrame, new_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects (object_id, revision, …) and parts (object_id, …) with those of new objects replaced whole; the revision counts on from the one before, and parts of no new object are left out."""
    before = objects.select("object_id", F.col("revision").alias("__r"))
    fresh = new_objects.join(before, "object_id", "left").withColumn("revision", F.coalesce("__r", F.lit(0)) + 1).select(*objects.columns)
    gone = new_objects.select("object_id").distinct()
    return objects.join(gone, "object_id", "left_anti").unionByName(fresh), parts.join(gone, "object_id", "left_anti").unionByName(new_parts.join(gone, "object_id", "left_semi"))


def revision_ready(objects: DataFrame, indexed: DataFrame, version: str) -> DataFrame:
    """objects (object_id, revision) with ready: whether that revision is indexed (object_id, revision, provider_version) by a version."""
    done = indexed.filter(F.col("provider_version") == version).select("object_id", "revision").distinct().withColumn("ready", F.lit(True))
    return objects.join(done, ["object_id", "revision"], "left").fillna(False, ["ready"])


def merge_risks(by_rule: DataFrame, by_model: DataFrame) -> DataFrame:
    """Risks (doc_id, category, severity) of rules, and those of a model in categories that no rule found in the document; source tells which. Of a model's risks of one category the most severe counts (critical, high, medium, low, then others), then the least of its other columns."""
    rest = [c for c in by_model.columns if c not in ("doc_id", "category")]
    level = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower("severity")), F.lit(0))
    ranked = by_model.select("doc_id", "category", F.struct(F.when(level > 0, level).otherwise(len(SEVERITIES) + 1).alias("__l"), *rest).alias("__x"), F.lit(False).alias("__r"))
    known = by_rule.select("doc_id", "category", (F.col("doc_id").isNotNull() & F.col("category").isNotNull()).alias("__r"))  # a null equals no other
    worst = ranked.unionByName(known, allowMissingColumns=True).groupBy("doc_id", "category").agg(F.min("__x").alias("__x"), F.bool_or("__r").alias("__r")).filter("__x is not null and not __r")
    extra = worst.select(*(F.col(c) if c not in rest else F.col(f"__x.{c}").alias(c) for c in by_model.columns))
    return by_rule.withColumn("source", F.lit("rule")).unionByName(extra.withColumn("source", F.lit("model")))


def add_column(columns: DataFrame, reviews: DataFrame, review: int, name: str) -> tuple[DataFrame, DataFrame]:
    """columns (review_id, col_id, name) with one more for a review, after its last, and reviews (review_id, schema_version) with its version one up."""
    last = columns.filter(F.col("review_id") == review).agg((F.coalesce(F.max("col_id"), F.lit(-1)) + 1).alias("col_id"))
    new = last.select(F.lit(review).cast(columns.schema["review_id"].dataType).alias("review_id"), F.col("col_id").cast(columns.schema["col_id"].dataType).alias("col_id"), F.lit(name).alias("name"))
    return columns.unionByName(new), reviews.withColumn("schema_version", F.col("schema_version") + (F.col("review_id") == review).cast("int"))


def append_history(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines beside those that a folder holds."""
    entries.write.mode("append").json(path)
