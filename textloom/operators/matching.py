"""Scores of entities in several pieces of a text, and of entities in boxes of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.spans import buckets

#: Places of a bucket in which fragments meet. Fixed value.
BUCKET = 64


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def fragment_scores(gold: DataFrame, predicted: DataFrame, key: str, match_type: bool = True, parts: int | None = None) -> DataFrame:
    """One row (exact_, boundary_, partial_ precision, recall and f1; gold, predicted): entities of several fragments.

    Rows (key, entity, label, start, end) are fragments: equal key and entity are
    one entity, with one label (of several the least). exact: equal fragments;
    boundary: equal first start and last end; each pairs entities of a key one to
    one. partial: for each entity, the greatest over those of the other side of
    its key of twice the shared characters over both sizes; overlapping fragments
    of one entity count once for each pair of fragments. With match_type, labels
    must be equal. Fragments without extent or a null key, entity, start or end
    have no part. Nothing on both sides scores 1, nothing on one 0.

    Fragments meet in the buckets of places that they touch and their shared
    characters are summed by pair, so no document is paired off as a whole. Both
    sides are dealt by key once, into parts partitions (by default the session's);
    everything else is grouped where it lies.
    """

    side = lambda rows, is_gold: rows.select(key, F.lit(is_gold).alias("g"), "entity", F.coalesce("label", F.lit("")).alias("label"), "start", "end").filter(f"`{key}` is not null and entity is not null and start < end")
    both = side(gold, True).unionByName(side(predicted, False))
    both = both.repartition(parts, key) if parts else both.repartition(key)
    by = [key, "label"] if match_type else [key]
    own = both.groupBy(key, "g", "entity").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"), F.min("start").alias("first"), F.max("end").alias("last"))
    alike = own.groupBy(*by, "parts", "first", "last").agg(F.count_if("g").alias("g"), F.count_if(~F.col("g")).alias("p"))
    ends = alike.groupBy(*by, "first", "last").agg(F.sum(F.least("g", "p")).alias("e"), F.sum("g").alias("g"), F.sum("p").alias("p"))  # equal fragments have equal ends
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    counts = ends.agg(total("g", "gold"), total("p", "predicted"), total("e", "e"), total(F.least("g", "p"), "b"))

    entity = Window.partitionBy(key, "g", "entity")
    sized = both.withColumn("size", F.sum(F.col("end") - F.col("start")).over(entity)).withColumn("label", F.min("label").over(entity))
    place = F.explode(buckets(F.col("start"), F.col("end"), BUCKET)).alias("bucket")
    met = sized.select(key, place, F.struct("g", "entity", "label", "size", "start", "end").alias("x")).groupBy(key, "bucket").agg(F.collect_list("x").alias("x"))
    met = met.select(key, "bucket", F.explode(F.filter("x", lambda x: x["g"])).alias("a"), F.filter("x", lambda x: ~x["g"]).alias("x"))
    met = met.select(key, "bucket", "a", F.explode(F.filter("x", lambda x: (x["start"] < F.col("a.end")) & (x["end"] > F.col("a.start")))).alias("b"))
    begin, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    fits = F.floor(begin / BUCKET) == F.col("bucket")  # a pair counts where the later of the two starts
    if match_type:
        fits &= F.col("a.label") == F.col("b.label")
    shared = met.filter(fits).groupBy(key, F.col("a.entity").alias("of"), F.col("b.entity").alias("to")).agg(F.sum(end - begin).alias("shared"), F.any_value(F.col("a.size") + F.col("b.size")).alias("size"))
    score = (2 * F.col("shared") / F.col("size")).alias("score")
    ways = shared.select(key, score, F.explode(F.array(F.struct(F.lit(True).alias("g"), F.col("of").alias("entity")), F.struct(F.lit(False).alias("g"), F.col("to").alias("entity")))).alias("w"))
    best = ways.groupBy(key, "w").agg(F.max("score").alias("s"))
    of_side = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("s"))), F.lit(0.0)).alias(name)
    one = counts.join(best.agg(of_side(F.col("w.g"), "recalled"), of_side(~F.col("w.g"), "precise")))
    out = []
    for name, for_p, for_r in (("exact", "e", "e"), ("boundary", "b", "b"), ("partial", "precise", "recalled")):
        nothing = (F.col("gold") == 0) & (F.col("predicted") == 0)
        precision, recall = F.when(nothing, 1.0).otherwise(_share(F.col(for_p), F.col("predicted"))), F.when(nothing, 1.0).otherwise(_share(F.col(for_r), F.col("gold")))
        out += [precision.alias(f"{name}_precision"), recall.alias(f"{name}_recall"), _f1(precision, recall).alias(f"{name}_f1")]
    return one.select("gold", "predicted", *out)


def box_pairs(left: DataFrame, right: DataFrame, page: str, cell: float = 64.0, same: tuple[str, ...] = (), beside: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of overlapping boxes (id, x0, y0, x1, y1) of a page, as (page, id, id_r, iou): shared area over joint area.

    same: columns in which both must be equal; beside: columns of either side to return too, those of the right end in _r.

    Boxes are dealt to the cells of a grid that they touch and meet there; a pair
    counts in the cell where its shared area begins, so it comes once and no page
    is paired off as a whole. cell: the side of a cell, about that of a usual box.
    Boxes without area or with a null side or page meet none.
    """

    def dealt(boxes: DataFrame, end: str) -> DataFrame:
        real = boxes.filter(f"x0 < x1 and y0 < y1 and `{page}` is not null").select(page, *(F.col(c).alias(c + end) for c in ("id", "x0", "y0", "x1", "y1", *beside)), *same)
        cells = [F.explode(F.sequence(F.floor(F.col(f"{a}0{end}") / cell), F.floor(F.col(f"{a}1{end}") / cell))).alias(f"__{a}") for a in "xy"]
        return real.select("*", cells[0]).select("*", cells[1])

    met = dealt(left, "").join(dealt(right, "_r"), [page, *same, "__x", "__y"])
    x, y = F.greatest("x0", "x0_r"), F.greatest("y0", "y0_r")
    wide, high = F.least("x1", "x1_r") - x, F.least("y1", "y1_r") - y
    once = (F.floor(x / cell) == F.col("__x")) & (F.floor(y / cell) == F.col("__y"))
    shared = wide * high
    area = lambda e: (F.col(f"x1{e}") - F.col(f"x0{e}")) * (F.col(f"y1{e}") - F.col(f"y0{e}"))
    return met.filter((wide > 0) & (high > 0) & once).select(page, "id", "id_r", F.try_divide(shared, area("") + area("_r") - shared).alias("iou"), *(c + e for c in beside for e in ("", "_r")))


def box_scores(gold: DataFrame, predicted: DataFrame, page: str, least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """One row: precision, recall and f1 of texts (text_), boxes (box_) and both (both_), mean_iou of overlapping pairs of one label, and counts gold and predicted.

    Boxes have id (unique on its side and page), label, text beside their sides.
    Texts are compared in lower case with single blanks; a gold one counts as
    found if any predicted one of its page and label has it. A box is found by one
    of its label with an IoU of at least ``least``; both: by one with its text too,
    each predicted one finding one gold one at most (first by greatest IoU).
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    g, p = (d.withColumn("said", plain).withColumn("label", F.coalesce("label", F.lit(""))) for d in (gold, predicted))
    texts = g.join(p.select(page, "label", "said").distinct(), [page, "label", "said"], "left_semi").agg(F.count(F.lit(1)).alias("texts"))
    named = box_pairs(g, p, page, cell, ("label",), ("said",))
    close = F.coalesce(F.col("iou") >= least, F.lit(False))
    row = lambda kind, if_, of, by, best: F.when(if_, F.struct(F.lit(kind).alias("kind"), of.alias("page"), by.alias("by"), F.when(F.lit(kind == "mean"), F.col("iou")).alias("iou"), best.alias("best")))
    rank = F.struct((-F.col("iou")).alias("iou"), F.col("id").alias("id"))
    none = lambda c: F.lit(None).cast(c)
    of_page, of_id, of_rank = (named.select(x.alias("x")).schema["x"].dataType for x in (F.col(page), F.col("id"), rank))
    kinds = F.array(
        row("mean", F.lit(True), none(of_page), none(of_id), none(of_rank)),
        row("box", close & F.col("id").isNotNull(), F.col(page), F.col("id"), none(of_rank)),
        row("both", close & (F.col("said") == F.col("said_r")), F.col(page), F.col("id_r"), rank),
    )  # what each count needs of a pair, so that pairs are met once and only close ones go on
    told = named.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).groupBy("x.kind", "x.page", "x.by").agg(F.sum("x.iou").alias("s"), F.count("x.iou").alias("n"), F.min("x.best").alias("best"))
    of = lambda kind: F.col("kind") == kind
    found = F.when(of("both") & F.col("best.id").isNotNull(), F.struct(F.col("page"), F.col("best.id").alias("id")))
    counts = told.agg(F.count_if(of("box")).alias("boxes"), F.countDistinct(found).alias("both"), F.coalesce(F.sum(F.when(of("mean"), F.col("s"))) / F.sum(F.when(of("mean") & (F.col("n") > 0), F.col("n"))), F.lit(0.0)).alias("mean_iou"))
    one = g.agg(F.count(F.lit(1)).alias("gold")).join(p.agg(F.count(F.lit(1)).alias("predicted"))).join(texts).join(counts)
    out = []
    for name, n in (("text", "texts"), ("box", "boxes"), ("both", "both")):
        precision, recall = _share(F.col(n), F.col("predicted")), _share(F.col(n), F.col("gold"))
        out += [precision.alias(f"{name}_precision"), recall.alias(f"{name}_recall"), _f1(precision, recall).alias(f"{name}_f1")]
    return one.select("gold", "predicted", "mean_iou", *out)
