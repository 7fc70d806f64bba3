"""Deterministic samples and annotation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mark(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by the least seeded hash of their keys: the same rows however the table is dealt out."""
    return df.orderBy(_mark(seed, *keys), *keys).limit(n)


def stratified_sample(df: DataFrame, stratum: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """ceil(n share) rows of each stratum by hash, then n of all. Quotas come from counts; each task keeps its quota before the shuffle."""
    c = df.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("EMPTY")).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    quota = c.withColumn("__q", F.ceil(F.col("__n") * n / F.sum("__n").over(Window.partitionBy())))
    order = Window.partitionBy("__s").orderBy(_mark(seed, *keys), *keys)
    rows = df.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("EMPTY"))).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= n)
    return rows.join(quota, "__s").filter(F.col("__k") <= F.col("__q")).orderBy(_mark(seed, *keys), *keys).limit(n).select(*df.columns)


def annotation_order(entities: DataFrame, doc: str, confidence: str) -> DataFrame:
    """Documents by the greatest 1 - confidence of their entities."""
    return entities.groupBy(doc).agg(F.max(1 - F.col(confidence)).alias("priority"))


def uncertainty_select(entities: DataFrame, doc: str, confidence: str, n: int) -> DataFrame:
    """The n documents with the least mean confidence."""
    return entities.groupBy(doc).agg(F.avg(confidence).alias("mean")).orderBy("mean", doc).limit(n)
