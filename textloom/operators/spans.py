"""Spans of text: overlap joins, islands, greedy selection, matching of gold and predicted spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import islands
from textloom.operators.pairing import one_to_one


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Two half-open intervals share a place."""
    return (s1 < e2) & (e1 > s2)


def buckets(start: Column, end: Column, width: int) -> Column:
    """The buckets of places that a span touches, in order."""
    return F.sequence(F.floor(start / width), F.greatest(F.floor((end - 1) / width), F.floor(start / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of overlapping spans (start, end) with equal keys; right columns other than the keys end in _r.

    Spans are dealt to the buckets of places they touch and joined there; a
    pair counts in the bucket where the later of the two starts, so it comes
    once and no document is paired off as a whole.
    """
    r = right.select(*keys, *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys))
    a = left.withColumn("__b", F.explode(buckets(F.col("start"), F.col("end"), width)))
    b = r.withColumn("__b", F.explode(buckets(F.col("start_r"), F.col("end_r"), width)))
    met = overlaps(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    return a.join(b, [*keys, "__b"]).filter(met & (F.floor(F.greatest("start", "start_r") / width) == F.col("__b"))).drop("__b")


def containing_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Overlap pairs in which the left span contains the right one."""
    return overlap_join(left, right, keys, width).filter("start <= start_r AND end >= end_r")


def self_overlaps(spans: DataFrame, keys: list[str], span_id: str, width: int = 64) -> DataFrame:
    """Each overlapping pair of one table once, the lesser id first."""
    return overlap_join(spans, spans, keys, width).filter(F.col(span_id) < F.col(f"{span_id}_r"))


def merge_overlapping(spans: DataFrame, keys: list[str], carry: str) -> DataFrame:
    """Overlapping spans fused to their union; `carry` of the first (least start, then greatest end) is kept."""
    order = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), carry)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", (before.isNull() | (F.col("start") >= before)).cast("int"))
    island = marked.withColumn("__k", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", (-F.col("end")).alias("e"), carry)).alias("f")).select(*keys, "start", "end", F.col(f"f.{carry}").alias(carry))


def greedy_nonoverlap(spans: Column) -> Column:
    """Of an array of structs with start and end: sorted by start, the longer first, each that starts at or after the end of the last kept."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end).cast("int"))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1).end <= s.start), F.concat(kept, F.array(s))).otherwise(kept))


def dedup_overlapping(spans: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """One of four ways to part overlapping spans (start, end, label, confidence) of each key: first, confidence, longer_same_type (spans of other labels do not count), shortest. Ties: by start, the surer, end, label."""
    size, sure = F.col("end") - F.col("start"), -F.col("confidence")
    order = {"first": [F.col("start"), sure], "confidence": [sure, F.col("start")], "longer_same_type": [-size, F.col("start")], "shortest": [size, F.col("start")]}[strategy]
    return islands.choose(spans, keys, [*order, F.col("end"), F.col("label")], "label" if strategy == "longer_same_type" else None)


match_gold = islands.match


def error_analysis(gold: DataFrame, predicted: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Rows (key, category, gold_label, label): each distinct gold span, in order, with the best prediction left whose overlap over joint length is more than `least`.

    Best: equal ends, then an equal label, then the overlap. correct; type
    (ends only); boundary (label only); partial (neither); false_negative: no
    prediction; false_positive: a prediction that no gold span took. Pairs
    come from an interval join and are sorted by key and rank; only those of a
    key meet in one task.
    """
    cols = ["start", "end", "label"]
    own = lambda df, prefix: df.select(key, *(F.col(c).alias(prefix + c) for c in cols)).distinct()
    g, p = own(gold, "g_"), own(predicted, "p_")
    shared = F.least("end", "end_r") - F.greatest("start", "start_r")
    iou = shared / ((F.col("end") - F.col("start")) + (F.col("end_r") - F.col("start_r")) - shared)
    met = overlap_join(gold.select(key, *cols).distinct(), predicted.select(key, *cols).distinct(), [key]).withColumn("__iou", iou).filter(F.col("__iou") > least)
    pairs = met.select(key, *(F.col(c).alias("g_" + c) for c in cols), *(F.col(c + "_r").alias("p_" + c) for c in cols), "__iou")

    apart = F.coalesce(F.col("g_label") != F.col("p_label"), F.lit(True))
    best = [(F.col("g_start") != F.col("p_start")) | (F.col("g_end") != F.col("p_end")), apart, F.desc("__iou")]
    place = lambda side: [F.asc_nulls_last(f"{side}_{c}") for c in cols]
    matched = one_to_one(pairs, key, [*place("g"), *best, *place("p")], ["g_start", "g_end", "g_label"], ["p_start", "p_end", "p_label"])
    same, kind = (F.col("g_start") == F.col("p_start")) & (F.col("g_end") == F.col("p_end")), F.col("g_label") == F.col("p_label")
    category = F.when(same & kind, "correct").when(same, "type").when(kind, "boundary").otherwise("partial")
    none = F.lit(None).cast("string")
    lost = g.join(matched.select(key, "g_start", "g_end", "g_label"), [key, "g_start", "g_end", "g_label"], "left_anti").select(key, F.lit("false_negative").alias("category"), F.col("g_label").alias("gold_label"), none.alias("label"))
    more = p.join(matched.select(key, "p_start", "p_end", "p_label"), [key, "p_start", "p_end", "p_label"], "left_anti").select(key, F.lit("false_positive").alias("category"), none.alias("gold_label"), F.col("p_label").alias("label"))
    return matched.select(key, category.alias("category"), F.col("g_label").alias("gold_label"), F.col("p_label").alias("label")).unionByName(lost).unionByName(more)


def match_scores(matches: DataFrame) -> DataFrame:
    """Precision, recall and F1, exact with label and by overlap, of rows from ``match_gold``."""
    exact, some = F.count_if(F.col("class") == "exact"), F.count_if(F.col("class").isin("exact", "exact_boundary", "partial", "overlap"))
    gold, predicted = F.count("gold_start"), F.count("start")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return matches.agg(share(exact, predicted).alias("precision_exact"), share(exact, gold).alias("recall_exact"), share(some, predicted).alias("precision_overlap"), share(some, gold).alias("recall_overlap"))


def bio_spans(tokens: DataFrame, key: str, position: str, token: str, tag: str) -> DataFrame:
    """Runs of B- and I- tags as rows (key, start, end, label, text) in token places: B-, a change of label, or an I- after O begins one."""
    order = Window.partitionBy(key).orderBy(position)
    label = F.when(F.col(tag).rlike("^[BI]-"), F.substring(F.col(tag), F.lit(3), F.length(tag)))
    rows = tokens.withColumn("__l", label).withColumn("__p", F.lag("__l").over(order))
    new = F.col("__l").isNotNull() & (F.col(tag).startswith("B-") | F.col("__p").isNull() | (F.col("__p") != F.col("__l")))
    runs = rows.withColumn("__k", F.sum(new.cast("int")).over(order)).filter("__l is not null")
    return runs.groupBy(key, "__k").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.first("__l").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, token))), lambda x: x[token]), " ").alias("text")).drop("__k")


def heal_adjacent(spans: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Neighbouring spans of one label at most `gap` apart joined."""
    order = Window.partitionBy(*keys, "label").orderBy("start", "end")
    far = F.lag("end").over(order)
    marked = spans.withColumn("__n", (far.isNull() | (F.col("start") - far > gap)).cast("int"))
    marked = marked.withColumn("__k", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "label", "__k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__k")
