"""Scores of predictions: confusion, classification, calibration, thresholds, rankings, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Rows for each pair of predicted and actual class."""
    return df.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def most_confused(df: DataFrame, predicted: str, actual: str, n: int) -> DataFrame:
    """The n most frequent wrong pairs."""
    return confusion(df, predicted, actual).filter("predicted <> actual").orderBy(F.desc("n"), "predicted", "actual").limit(n)


def per_class(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn of each class, from one pass over the rows."""
    cells = confusion(df, predicted, actual)
    hit = (F.col("predicted") == F.col("actual")).alias("hit")
    side = lambda name, own: F.struct(F.col(name).alias("class"), F.lit(own).alias("own"), F.col("n").alias("k"), hit)
    sides = cells.select(F.inline(F.array(side("actual", 1), side("predicted", 0))))
    return sides.groupBy("class").agg(F.sum(F.when((F.col("own") == 1) & F.col("hit"), F.col("k")).otherwise(0)).alias("tp"), F.sum(F.when((F.col("own") == 0) & ~F.col("hit"), F.col("k")).otherwise(0)).alias("fp"), F.sum(F.when((F.col("own") == 1) & ~F.col("hit"), F.col("k")).otherwise(0)).alias("fn"))


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def classification(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy; micro and support-weighted F1; macro precision over classes that occur or are wrongly predicted, macro recall over those that occur, and the F1 of those two."""
    c = per_class(df, predicted, actual)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    support = F.col("tp") + F.col("fn")
    s = c.withColumns({"p": p, "r": r, "f": _f1(p, r), "support": support}).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), _f1(F.sum("tp") / F.sum(F.col("tp") + F.col("fp")), F.sum("tp") / F.sum("support")).alias("micro_f1"), (F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("p").alias("macro_p"), F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("macro_r")
    )
    return s.withColumn("macro_f1", _f1(F.col("macro_p"), F.col("macro_r")))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """For each bin of equal width: rows, mean confidence and accuracy; confidence 1 is in the last."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.sum(F.pow(F.col(confidence) - F.col(correct).cast("double"), 2)).alias("squares"))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error and the Brier score; no rows: zeros."""
    b, n = calibration_bins(df, confidence, correct, bins), F.sum("n")
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return b.agg(F.coalesce(F.sum(F.col("n") * gap) / n, F.lit(0.0)).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"), F.coalesce(F.sum("squares") / n, F.lit(0.0)).alias("brier"))


def threshold_curve(df: DataFrame, confidence: str, correct: str, points: int = 20) -> DataFrame:
    """Precision (none kept: 1) and recall (none correct: 1) of the rows at or above each of points + 1 even thresholds.

    Rows are first counted by the highest threshold they reach, so the curve
    is a running sum over points + 1 rows.
    """
    step = F.least(F.floor(F.col(confidence) * points + 1e-9), F.lit(points)).cast("int")
    counted = df.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("good"))
    grid = df.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("k")).join(counted, "k", "left").fillna(0)
    above = Window.orderBy(F.col("k").desc())
    total = Window.partitionBy()
    rows = grid.withColumns({"kept": F.sum("n").over(above), "hit": F.sum("good").over(above), "all": F.sum("good").over(total)})
    p = F.when(F.col("kept") == 0, 1.0).otherwise(F.col("hit") / F.col("kept"))
    r = F.when(F.col("all") == 0, 1.0).otherwise(F.col("hit") / F.col("all"))
    return rows.select((F.col("k") / points).alias("threshold"), "kept", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def ranking(df: DataFrame, query: str, rank: str, relevant: str, k: int) -> DataFrame:
    """Mean reciprocal rank, first-place share and share of queries with a relevant row in the first k; ranks count from 1."""
    first = df.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first"))
    return first.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("p_at_1"), F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias("hits"))


def retrieval_scores(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """recall@k and nDCG@k for each query. hits: query, doc, rank from 0; qrels: query, doc, grade. No relevant document: 1; gain 2^grade - 1, discount log2(rank + 2)."""
    gain = lambda: F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = Window.partitionBy("query").orderBy(F.desc("grade"), "doc")
    best = qrels.withColumn("place", F.row_number().over(ideal) - 1).groupBy("query").agg(F.count_if(F.col("grade") >= 1).alias("relevant"), F.sum(F.when(F.col("place") < k, gain() / F.log2(F.col("place") + 2)).otherwise(0.0)).alias("ideal"))
    got = hits.filter(F.col("rank") < k).join(qrels, ["query", "doc"]).groupBy("query").agg(F.count_if(F.col("grade") >= 1).alias("found"), F.sum(gain() / F.log2(F.col("rank") + 2)).alias("dcg"))
    both = best.join(got, "query", "left").fillna(0, ["found", "dcg"])
    return both.select("query", F.when(F.col("relevant") == 0, 1.0).otherwise(F.col("found") / F.col("relevant")).alias("recall"), F.when(F.col("ideal") == 0, 1.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def imbalance(df: DataFrame, key: str) -> DataFrame:
    """Rows of the largest class over those of the smallest; none: 1."""
    return df.groupBy(key).count().agg(F.coalesce(F.max("count") / F.min("count"), F.lit(1.0)).alias("ratio"))


def long_tail(df: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Classes by size: the first ceil(n share) are head, the last as many tail, the rest mid; with the share of all rows up to each."""
    sizes = df.groupBy(F.col(key).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    order, all_ = Window.orderBy(F.desc("n"), "class"), Window.partitionBy()
    rows = sizes.withColumns({"rank": F.row_number().over(order), "classes": F.count(F.lit(1)).over(all_), "upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(all_)})
    edge = F.ceil(F.col("classes") * share)
    return rows.select("class", "n", "rank", F.when(F.col("rank") <= edge, "head").when(F.col("rank") > F.col("classes") - edge, "tail").otherwise("mid").alias("part"), F.col("upto").alias("coverage"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """Agreement of raters over items with the labels they gave: (observed - chance) / (1 - chance)."""
    cells = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    per_item = cells.groupBy(item).agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("agree"))
    observed = per_item.agg(F.avg("agree").alias("observed"), F.count(F.lit(1)).alias("items"))
    shares = cells.groupBy(label).agg(F.sum("n").alias("n")).join(F.broadcast(observed)).select("observed", F.pow(F.col("n") / (F.col("items") * raters), 2).alias("sq"))
    return shares.groupBy("observed").agg(F.sum("sq").alias("chance")).select("observed", "chance", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).otherwise(1.0).alias("kappa"))


def majority(votes: DataFrame, keys: list[str], label: str, annotators: int) -> DataFrame:
    """The label most often given to each key (ties: the first label) and (votes / annotators) (best / votes) as confidence."""
    c = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)
    ranked = c.withColumns({"votes": F.sum("n").over(by), "k": F.row_number().over(by.orderBy(F.desc("n"), label))})
    return ranked.filter("k = 1").select(*keys, F.col(label).alias("label"), "votes", ((F.col("votes") / annotators) * (F.col("n") / F.col("votes"))).alias("confidence"))
