"""Change between sets and windows of predictions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_windows(df: DataFrame, order: list[str], size: int, windows: int) -> DataFrame:
    """df with window 0 (the newest) to windows - 1: blocks of `size` rows from the end; what is before them, or does not fill one, goes.

    The rows are ranked within ranges of the order first, so no task sorts all.
    """
    newest = df.orderBy(*(F.col(c).desc() for c in order)).limit(size * windows)
    ranked = newest.withColumn("__k", F.row_number().over(Window.orderBy(*(F.col(c).desc() for c in order))) - 1)
    full = ranked.withColumn("window", F.floor(F.col("__k") / size).cast("int"))
    complete = full.groupBy("window").count().filter(F.col("count") == size).select("window")
    return full.join(F.broadcast(complete), "window").drop("__k")


def window_stats(windowed: DataFrame, value: str, kind: str) -> DataFrame:
    """For each window: rows, mean, population deviation and number of kinds."""
    return windowed.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.countDistinct(kind).alias("kinds"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Share of each value."""
    c = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def kl_divergence(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Sum over the current values of p ln(p / q), q being 1e-10 where the baseline lacks one."""
    p, q = distribution(current, key).select("key", "p"), distribution(baseline, key).select("key", F.col("p").alias("q"))
    return p.join(q, "key", "left").agg(F.coalesce(F.sum(F.col("p") * F.log(F.col("p") / F.coalesce("q", F.lit(1e-10)))), F.lit(0.0)).alias("kl"))


def js_divergence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence in bits: 0 to 1."""
    p, q = distribution(a, key).select("key", "p"), distribution(b, key).select("key", F.col("p").alias("q"))
    both = p.join(q, "key", "full").fillna(0.0, ["p", "q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).otherwise(0.0)
    return both.agg(((F.sum(part("p")) + F.sum(part("q"))) / 2 / F.log(F.lit(2.0))).alias("js"))


def vocabulary_drift(current: DataFrame, baseline: DataFrame, text: str) -> DataFrame:
    """Share of the current distinct lower-case words that the baseline lacks; no baseline: 0."""
    words = lambda df: df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''").distinct()
    known = words(baseline).withColumn("known", F.lit(1))
    rows = words(current).join(known, "w", "left")
    some = baseline.limit(1).agg(F.count(F.lit(1)).alias("some"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("old")).join(F.broadcast(some)).select(F.when((F.col("some") == 0) | (F.col("n") == 0), 0.0).otherwise(1 - F.col("old") / F.col("n")).alias("drift"))


def leakage(test: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """Test rows whose lower-case text is in train, repeats counted, and their share."""
    known = train.select(F.lower(text).alias("__t")).distinct().withColumn("__in", F.lit(1))
    return test.select(F.lower(text).alias("__t")).join(known, "__t", "left").agg(F.count("__in").alias("leaked"), F.coalesce(F.count("__in") / F.count(F.lit(1)), F.lit(0.0)).alias("share"))


def redundancy(df: DataFrame, text: str) -> DataFrame:
    """Share of rows whose lower-case text stood before."""
    return df.groupBy(F.lower(text).alias("t")).count().agg(F.coalesce(1 - F.count(F.lit(1)) / F.sum("count"), F.lit(0.0)).alias("redundancy"))


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Texts, words, distinct words, and mean, upper median and population deviation of the words of a text."""
    rows = df.select(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("w"))
    sizes = rows.select(F.size("w").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))  # a row for each length
    upto, all_ = F.sum("rows").over(Window.orderBy("n")), F.sum("rows").over(Window.partitionBy())
    median = sizes.withColumns({"upto": upto, "all": all_}).filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median"))
    whole = rows.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("w")).alias("words"), F.avg(F.size("w")).alias("mean"), F.stddev_pop(F.size("w")).alias("std"))
    distinct = rows.select(F.explode("w").alias("x")).distinct().agg(F.count(F.lit(1)).alias("distinct_words"))
    return whole.join(F.broadcast(median)).join(F.broadcast(distinct))
