"""Overlapping spans settled island by island: greedy choice, stacked layers, gold against predictions.

One window finds the islands: spans that overlap directly or through others.
Spans of different islands never meet, so each island is folded by itself, as an
aggregate over the array of its spans inside the JVM; a document with many
islands is many rows. A span alone in its island needs no fold's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types with a fixed written form, which take the place of an unspecific span within them. Fixed values.
STRUCTURED = ("MONEY", "DATE", "TIME", "PERCENT", "EMAIL", "URL", "PHONE", "QUANTITY")
#: Types with a meaning of their own; any other label is unspecific. Fixed values.
NAMED = ("PER", "ORG", "LOC", *STRUCTURED)
STRATEGIES = ("priority", "longest", "confidence", "union")


def number_islands(spans: DataFrame, keys: list[str], name: str = "island") -> DataFrame:
    """spans with the number of their island among those of their keys, from 1 by place. Half-open spans that touch are apart; an empty span (end at or before start) belongs where it starts."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("start") >= before)).cast("int")
    return spans.withColumn("__f", fresh).withColumn(name, F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _fold(spans: DataFrame, keys: list[str], order: list[Column], fold: Callable[[Column], Column]) -> DataFrame:
    """Each island's spans, as structs led by __o (their place in order), through fold; the spans that it returns, with all columns."""
    rest = [c for c in spans.columns if c not in keys]
    numbered = number_islands(spans, keys, "__i")
    lead = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))
    items = numbered.groupBy(*keys, "__i").agg(F.array_sort(F.collect_list(F.struct(lead.alias("__o"), *(F.col(c) for c in rest)))).alias("__s"))
    kept = F.when(F.size("__s") > 1, fold(F.col("__s"))).otherwise(F.col("__s"))
    return items.select(*keys, F.explode(kept).alias("__x")).select(*keys, *(F.col(f"__x.{c}").alias(c) for c in rest))


def choose(spans: DataFrame, keys: list[str], order: list[Column], same: str | None = None) -> DataFrame:
    """spans, in the given order within their keys, of which each is kept that overlaps no kept one (same: none with an equal value of that column). Ties in order fall to the least of the other columns; null keys are one group; copies of a span overlap each other, so one stays."""
    key = [*keys, same] if same else keys
    empty = lambda s: F.slice(s, 1, 0)
    return _fold(spans, key, order, lambda all_: F.aggregate(all_, empty(all_), lambda kept, s: F.when(F.exists(kept, lambda k: _meet(k, s)), kept).otherwise(F.concat(kept, F.array(s))))).select(*spans.columns)


def _best(hits: Column, better: Callable[[Column, Column], Column]) -> Column:
    """Of a list the first that no other is better than."""
    return F.aggregate(hits, F.get(hits, F.lit(0)), lambda best, h: F.when(better(h, best), h).otherwise(best))


def stack(spans: DataFrame, keys: list[str], strategy: str = "priority") -> DataFrame:
    """Spans (start, end, label, confidence, layer) of several recognisers laid over each other, layer by layer, within a layer by place.

    A span that overlaps nothing kept stays. Otherwise it meets the best kept one
    that it overlaps (priority: the earliest in the list; longest, confidence: the
    greatest, then the earliest), and takes its place if it is better by the
    strategy (priority: never), or if it has a structured type and covers a span
    of an unspecific one; whichever of the two wins, the other kept ones that it
    overlaps go. union keeps all. Of kept spans with equal ends and label one
    stays, but for union. Spans without extent and with null ends go; a null
    confidence counts as 0.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    real = spans.filter("start < end")
    if strategy == "union":
        return real
    size = lambda s: s["end"] - s["start"]
    sure = lambda s: F.coalesce(s["confidence"].cast("double"), F.lit(0.0))
    better = {"priority": lambda a, b: F.lit(False), "longest": lambda a, b: size(a) > size(b), "confidence": lambda a, b: sure(a) > sure(b)}[strategy]

    def takes(new: Column, old: Column) -> Column:
        unspecific = old["label"].isNull() | ~F.upper(old["label"]).isin(*NAMED)
        covers = (new["start"] <= old["start"]) & (new["end"] >= old["end"]) & F.upper(F.coalesce(new["label"], F.lit(""))).isin(*STRUCTURED) & unspecific
        return covers | better(new, old)

    def step(kept: Column, new: Column) -> Column:
        hits = F.filter(kept, lambda k: _meet(k, new))
        best = _best(hits, better)
        met = F.transform(F.filter(kept, lambda k: ~_meet(k, new) | (k["__o"] == best["__o"])), lambda k: F.when((k["__o"] == best["__o"]) & takes(new, best), new).otherwise(k))
        return F.when(F.size(hits) == 0, F.concat(kept, F.array(new))).otherwise(met)

    kept = _fold(real, keys, [F.col("layer"), F.col("start"), F.col("end")], lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), step))
    return kept.dropDuplicates([*keys, "start", "end", "label"]).select(*spans.columns)


def match(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Each gold span with at most one prediction, as (key, gold_start, gold_end, gold_label, start, end, label, class), in order of gold within an island.

    Best first: equal ends and label (exact), equal ends (exact_boundary), overlap
    and label (partial), overlap; of equals the first by place. class none: no
    prediction left that overlaps; spurious: a prediction that no gold span took.
    Spans without extent match nothing; a null key is a key of its own.
    """
    cols = ["start", "end", "label"]
    both = gold.select(key, *cols, F.lit(True).alias("__g")).unionByName(predicted.select(key, *cols, F.lit(False).alias("__g")))
    items = number_islands(both, [key], "__i").groupBy(key, "__i").agg(F.array_sort(F.collect_list(F.struct(*cols, "__g"))).alias("__s"))
    of = lambda mine: F.transform(F.filter("__s", lambda s: s["__g"] == mine), lambda s, k: F.struct(k.alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    items = items.select(key, of(F.lit(True)).alias("g"), of(F.lit(False)).alias("p"))

    def rank(g: Column, p: Column) -> Column:
        return F.when((g["start"] == p["start"]) & (g["end"] == p["end"]), 0).otherwise(2) + F.when(g["label"].eqNullSafe(p["label"]), 0).otherwise(1)

    def step(done: Column, g: Column) -> Column:
        free = F.filter("p", lambda p: _meet(p, g) & ~F.exists(done, lambda d: d["n"].eqNullSafe(p["n"])))
        best = F.array_min(F.transform(free, lambda p: F.struct(rank(g, p).alias("rank"), p["n"].alias("n"))))
        return F.concat(done, F.array(F.struct(best["rank"].alias("rank"), best["n"].alias("n"))))

    none = F.array().cast("array<struct<rank:int,n:int>>")
    taken = items.select(key, "g", "p", F.aggregate("g", none, step).alias("t"))
    class_of = F.when(F.col("r").isNull(), "none").otherwise(F.get(F.array(*map(F.lit, ("exact", "exact_boundary", "partial", "overlap"))), F.col("r")))
    matched = taken.select(key, "p", F.explode(F.arrays_zip("g", "t")).alias("x")).select(
        key, F.col("x.g.start").alias("gold_start"), F.col("x.g.end").alias("gold_end"), F.col("x.g.label").alias("gold_label"), F.get("p", F.col("x.t.n")).alias("q"), F.col("x.t.rank").alias("r")
    ).select(key, "gold_start", "gold_end", "gold_label", "q.start", "q.end", "q.label", class_of.alias("class"))
    spurious = taken.select(key, F.explode(F.filter("p", lambda p: ~F.exists("t", lambda t: t["n"].eqNullSafe(p["n"])))).alias("q"))
    nothing = [F.lit(None).cast(gold.schema[c].dataType).alias(f"gold_{c}") for c in cols]
    return matched.unionByName(spurious.select(key, *nothing, "q.start", "q.end", "q.label", F.lit("spurious").alias("class")))
