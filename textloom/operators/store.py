"""Tables that change: upserts, deletes, retries and registries as set operations over immutable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.retrieval import under_folder


def merge(table: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with the rows of batch in the place of those of equal keys; of repeats in batch the greatest order stays. table is not sorted, only anti-joined."""
    if order is not None:
        rest = [c for c in batch.columns if c not in keys]
        batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*").select(*table.columns)
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def insert_if_absent(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows of batch whose keys it lacks."""
    return table.unionByName(batch.join(table.select(*keys).distinct(), keys, "left_anti"))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of the given keys."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_folder(chunks: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chunks outside a folder, and one row with the numbers of rows, documents and paths that went."""
    inside = under_folder(F.col("source_path"), folder)
    went = chunks.filter(inside).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("source_path").alias("paths"))
    return chunks.filter(~inside | inside.isNull()), went


def forget_scope(tables: dict[str, DataFrame], objects: DataFrame, scope: Column) -> dict[str, DataFrame]:
    """Every table (by object_id) without the objects of a scope; objects too."""
    gone = objects.filter(scope).select("object_id")
    return {name: df.join(gone, "object_id", "left_anti") for name, df in {**tables, "objects": objects}.items()}


def mark_pending(status: DataFrame, failed: DataFrame) -> DataFrame:
    """status with one attempt more for each failed document (doc_id, error), new ones at one."""
    before = status.select("doc_id", F.col("attempts").alias("__a"))
    rows = failed.join(before, "doc_id", "left").select("doc_id", F.lit("pending").alias("status"), (F.coalesce("__a", F.lit(0)) + 1).alias("attempts"), F.col("error").alias("last_error"))
    return merge(status.select("doc_id", "status", "attempts", "last_error"), rows, ["doc_id"])


def overlapping_roots(roots: DataFrame, root: str) -> DataFrame:
    """Registered roots (corpus_id, root) that hold, or lie in, a new one: a registration must find none."""
    plain = F.regexp_replace(F.lower(F.translate("root", "\\", "/")), "/+$", "")
    new = root.lower().replace("\\", "/").rstrip("/")
    return roots.filter((plain == new) | plain.startswith(new + "/") | F.lit(new).startswith(F.concat(plain, F.lit("/"))))


def freshness(runs: DataFrame) -> DataFrame:
    """For each corpus its last finished run and how many failed since."""
    last = F.max(F.when(F.col("status") == "done", F.col("finished_at"))).over(Window.partitionBy("corpus_id"))
    return runs.withColumn("__l", last).groupBy("corpus_id").agg(F.first("__l").alias("last_done"), F.count_if((F.col("status") == "failed") & (F.col("__l").isNull() | (F.col("finished_at") > F.col("__l")))).alias("failed_since"))


def transition(jobs: DataFrame, to: str, allowed: dict[str, set[str]], ids: DataFrame) -> DataFrame:
    """jobs with the status of the given ids moved where the move is allowed; others stay."""
    may = F.col("status").isin([a for a, bs in allowed.items() if to in bs])
    return jobs.join(ids.select("job_id").distinct().withColumn("__hit", F.lit(True)), "job_id", "left").withColumn("status", F.when(F.col("__hit") & may, to).otherwise(F.col("status"))).drop("__hit")
