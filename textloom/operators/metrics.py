"""Further scores: extraction quality, bias by length and group, agreement of annotators, relations, document comparison, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def extraction_quality(entities: DataFrame, kind: str, text: str, noisy: Column) -> DataFrame:
    """Entities, repeats of (kind, collapsed lower-case text), noisy ones, and both rates."""
    key = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    c = entities.groupBy(F.col(kind), key.alias("__t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(noisy).alias("noise"))
    s = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("noise"), F.lit(0)).alias("noisy"))
    return s.withColumns({"duplicate_rate": _share(F.col("duplicates"), F.col("total")), "noise_rate": _share(F.col("noisy"), F.col("total"))})


def length_bias(entities: DataFrame, text: str, correct: Column) -> DataFrame:
    """Share recognised by length in characters: up to 5, 15, 30, 50 and more."""
    n = F.length(text)
    bucket = F.when(n <= 5, "very_short").when(n <= 15, "short").when(n <= 30, "medium").when(n <= 50, "long").otherwise("very_long")
    return entities.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("rate"))


def word_count_bias(entities: DataFrame, text: str, correct: Column) -> DataFrame:
    """Share recognised by number of words: 1, 2, 3, 4 and more."""
    n = F.least(F.size(F.split(F.trim(F.col(text)), r"\s+")), F.lit(4))
    return entities.groupBy(n.alias("words")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("rate"))


def group_gap(df: DataFrame, group: str, correct: Column) -> DataFrame:
    """Groups, the best and the worst share right, and the gap between them."""
    rates = df.groupBy(group).agg(F.avg(correct.cast("double")).alias("rate"))
    return rates.agg(F.count(F.lit(1)).alias("groups"), F.max("rate").alias("best"), F.min("rate").alias("worst"), (F.max("rate") - F.min("rate")).alias("gap"))


def annotator_agreement(votes: DataFrame, keys: list[str], label: str, annotators: int) -> DataFrame:
    """Share of spans that every annotator marked, share that all marked alike, and the mean contention 1 - most votes / annotators. A row of votes for each annotator and span."""
    c = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    spans = c.groupBy(*keys).agg(F.sum("n").alias("votes"), F.count(F.lit(1)).alias("labels"), F.max("n").alias("most"))
    whole = F.col("votes") >= annotators
    return spans.agg(F.count(F.lit(1)).alias("spans"), F.avg(whole.cast("double")).alias("span_agreement"), F.avg((whole & (F.col("labels") == 1)).cast("double")).alias("type_agreement"), F.avg(1 - F.col("most") / annotators).alias("contention"))


def one_to_one(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of rows matched one to one on equal keys: of each key the lesser of the two counts. Both sides empty: 1.

    For equal keys any greedy order matches as many, so no order is needed.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = side(gold, "g").join(side(predicted, "p"), keys, "full").fillna(0, ["g", "p"])
    s = both.agg(F.coalesce(F.sum(F.least("g", "p")), F.lit(0)).alias("hit"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"))
    empty = (F.col("gold") == 0) & (F.col("predicted") == 0)
    p, r = (F.when(empty, 1.0).otherwise(_share(F.col("hit"), F.col(c))) for c in ("predicted", "gold"))
    return s.select("hit", "gold", "predicted", p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"))


def relation_scores(gold: DataFrame, predicted: DataFrame, undirected: bool = False) -> DataFrame:
    """``one_to_one`` on (doc_id, head, tail, relation), the relation's case apart; undirected: the lesser end first."""

    def keyed(df: DataFrame) -> DataFrame:
        a, b = (F.least("head", "tail"), F.greatest("head", "tail")) if undirected else (F.col("head"), F.col("tail"))
        return df.select("doc_id", a.alias("a"), b.alias("b"), F.lower("relation").alias("r"))

    return one_to_one(keyed(gold), keyed(predicted), ["doc_id", "a", "b", "r"])


def bridging_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Share of predicted links that some gold link equals (it may be used again), and of gold links that some predicted one equals."""
    hit = lambda a, b: a.join(b.select(*keys).distinct().withColumn("__h", F.lit(1)), keys, "left").agg(F.count("__h").alias("h"), F.count(F.lit(1)).alias("n"))
    p, r = hit(predicted, gold).select(_share(F.col("h"), F.col("n")).alias("precision")), hit(gold, predicted).select(_share(F.col("h"), F.col("n")).alias("recall"))
    return p.join(r).withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Shared distinct keys over all (both empty: 1), and how many rows, repeats counted, stayed, came and went."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = side(left, "a").join(side(right, "b"), keys, "full").fillna(0, ["a", "b"])
    shared = F.count_if((F.col("a") > 0) & (F.col("b") > 0))
    jaccard = F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(shared / F.count(F.lit(1)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(jaccard.alias("jaccard"), total(F.least("a", "b")).alias("unchanged"), total(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), total(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))


def window_fragmentation(mentions: DataFrame, size: int, overlap: int) -> DataFrame:
    """Gold chains over more than one window of characters, and those of them whose windows fall into more than one predicted chain. mentions: doc_id, start, gold, pred."""
    step = max(1, size - overlap)
    m = mentions.withColumn("w", F.floor(F.col("start") / step))
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    chains = m.groupBy("doc_id", "gold").agg(several("w").alias("spans"), several("pred").alias("parts"), F.count_if(F.col("pred").isNull()).alias("missing"))
    return chains.agg(F.count(F.lit(1)).alias("chains"), F.count_if("spans").alias("spanning"), F.count_if(F.col("spans") & F.col("parts")).alias("fragmented"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))


def learning_curve(points: DataFrame, size: str, score: str) -> DataFrame:
    """Least-squares line of the score over the logarithm of the training size: slope, intercept, fit."""
    x = F.log(F.col(size))
    return points.agg(F.regr_slope(F.col(score), x).alias("slope"), F.regr_intercept(F.col(score), x).alias("intercept"), F.regr_r2(F.col(score), x).alias("r2"))


def robustness(scores: DataFrame, perturbation: str, score: str, clean: str = "identity") -> DataFrame:
    """Mean score under each perturbation and its share of the clean one."""
    base = scores.filter(F.col(perturbation) == clean).agg(F.avg(score).alias("clean"))
    return scores.groupBy(perturbation).agg(F.avg(score).alias("mean")).join(F.broadcast(base)).withColumn("kept", _share(F.col("mean"), F.col("clean")))


def singleton_reasons(entities: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities named once in their document, by reason: a capital word also found elsewhere is likely missed, a capital one unique, the rest generic."""
    t = entities.select(doc, text, F.lower(text).alias("__t"))
    once = t.groupBy(doc, "__t").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias(text)).filter("n = 1")
    spread = t.groupBy("__t").agg(F.countDistinct(doc).alias("docs"))
    first = F.substring(text, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return once.join(spread, "__t").select(doc, text, F.when(~capital, "generic").when(F.col("docs") > 1, "likely_missed").otherwise("unique_name").alias("reason"))
