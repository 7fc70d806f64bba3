"""Evaluation history: counts, rollups, regressions. A row: backend, dataset, commit, ts, f1 and optional measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(history: DataFrame, *keys: str) -> DataFrame:
    """Rows for each value of the keys."""
    return history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stats(history: DataFrame) -> DataFrame:
    """One row: entries, backends, datasets and the mean of the known scores."""
    return history.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("backend").alias("backends"), F.countDistinct("dataset").alias("datasets"), F.avg("f1").alias("mean_f1"))


def outcome_rollup(history: DataFrame, keys: list[str], score: str = "f1", failed: Column | None = None) -> DataFrame:
    """For each key: rows, failures, mean, population deviation and standard error of the score."""
    failed = F.lit(False) if failed is None else failed
    return history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), (F.stddev_pop(score) / F.sqrt(F.count(F.lit(1)))).alias("stderr")
    )


def best_per_group(history: DataFrame, keys: list[str], score: str, n: int, tie: str) -> DataFrame:
    """The n best rows of each group; ties by the tie column. The window keeps n rows of each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return history.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recent(history: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The n newest rows."""
    return history.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def between(history: DataFrame, start: str, end: str, backend: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows of an inclusive range of times, optionally of one backend."""
    rows = history.filter(F.col(ts).between(start, end))
    return rows if backend is None else rows.filter(F.col("backend") == backend)


def half_split_drops(history: DataFrame, keys: list[str], least_drop: float, score: str = "f1", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Groups whose mean over the earlier half (rounded down) less that over the later half is at least least_drop, with both means."""
    by = Window.partitionBy(*keys)
    rows = history.withColumns({"__k": F.row_number().over(by.orderBy(ts, tie)), "__n": F.count(F.lit(1)).over(by)})
    early = F.col("__k") <= F.floor(F.col("__n") / 2)
    halves = rows.groupBy(*keys).agg(F.avg(F.when(early, F.col(score))).alias("before"), F.avg(F.when(~early, F.col(score))).alias("after"))
    return halves.withColumn("drop", F.col("before") - F.col("after")).filter(F.col("drop") >= least_drop)


def recent_window_drops(history: DataFrame, keys: list[str], last: int, least_old: int = 3, score: str = "f1", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Mean of the last rows against the earlier ones, with Cohen's d of the two by sample variances."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    rows = history.withColumn("__k", F.row_number().over(newest))
    new, old = F.when(F.col("__k") <= last, F.col(score)), F.when(F.col("__k") > last, F.col(score))
    out = rows.groupBy(*keys).agg(F.avg(old).alias("before"), F.avg(new).alias("after"), F.var_samp(old).alias("v1"), F.var_samp(new).alias("v2"), F.count(old).alias("n_old"))
    return out.filter(F.col("n_old") >= least_old).select(*keys, "before", "after", (F.col("before") - F.col("after")).alias("drop"), ((F.col("before") - F.col("after")) / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("d"))


def commit_drops(history: DataFrame, keys: list[str], old: str, new: str, least_drop: float, score: str = "f1") -> DataFrame:
    """Groups present at both commits whose mean fell by at least least_drop: one pass, no self-join."""
    means = history.filter(F.col("commit").isin(old, new)).groupBy(*keys).agg(F.avg(F.when(F.col("commit") == old, F.col(score))).alias("before"), F.avg(F.when(F.col("commit") == new, F.col(score))).alias("after"))
    return means.withColumn("drop", F.col("before") - F.col("after")).filter(F.col("drop") >= least_drop)


def cohens_d(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Effect size between the rows where group holds and the others, by the mean of the sample variances."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    return df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), ((F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("d"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean paired difference, t, and a p-value in steps (0.01, 0.05, 0.10, 1): the bounds are 2.576 and 1.96 from 30 pairs on, 2.75 and 2.04 below; under two pairs 1."""
    d = F.col(a) - F.col(b)
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    many = F.col("n") >= 30
    p = F.when(F.col("n") < 2, 1.0).when(F.abs("t") > F.when(many, 2.576).otherwise(2.75), 0.01).when(F.abs("t") > F.when(many, 1.96).otherwise(2.04), 0.05).otherwise(0.10)
    return s.withColumn("t", t).withColumn("p", p)


def seed_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, least and greatest of each group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))


def confidence_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and half width t s / sqrt(n): t is 1.96 from 30 rows on, else 2 + 0.1 / sqrt(n)."""
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    t = F.when(F.col("n") >= 30, 1.96).otherwise(2 + 0.1 / F.sqrt("n"))
    return s.withColumn("half", t * F.col("std") / F.sqrt("n"))
