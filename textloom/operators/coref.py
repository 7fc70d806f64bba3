"""Coreference scores over mentions (side gold or pred, doc_id, chain_id, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.pairing import one_to_one

KEYS = ["doc_id", "start", "end"]


def _sides(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda s: mentions.filter(F.col("side") == s).select(*KEYS, F.col("chain_id").alias(s)).dropDuplicates(KEYS)
    return side("gold"), side("pred")


def common(mentions: DataFrame) -> DataFrame:
    """Mentions of both sides with their two chains."""
    gold, pred = _sides(mentions)
    return gold.join(pred, KEYS)


def _share(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(p, r) -> list:
    return [p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1")]


def muc(mentions: DataFrame) -> DataFrame:
    """Links kept: size of a chain less the number of other-side chains it falls into, over size less one; common mentions only, singletons give nothing."""
    m = common(mentions)

    def side(own: str, other: str, name: str) -> DataFrame:
        chains = m.groupBy("doc_id", own).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(other).alias("parts"))
        return chains.agg(F.coalesce(F.sum(F.col("n") - F.col("parts")), F.lit(0)).alias(f"{name}_hit"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{name}_all"))

    both = side("pred", "gold", "p").join(side("gold", "pred", "r"))
    return both.select(*_prf(_share(F.col("p_hit"), F.col("p_all")), _share(F.col("r_hit"), F.col("r_all"))))


def _cells(mentions: DataFrame) -> DataFrame:
    """(doc_id, gold, pred, n) of common mentions."""
    return common(mentions).groupBy("doc_id", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def b_cubed(mentions: DataFrame) -> DataFrame:
    """For each common mention its chains' overlap over the size of its own chain, full size, averaged over mentions."""
    size = lambda s: mentions.filter(F.col("side") == s).groupBy("doc_id", F.col("chain_id").alias(s)).agg(F.count(F.lit(1)).alias(f"{s}_n"))
    rows = _cells(mentions).join(size("gold"), ["doc_id", "gold"]).join(size("pred"), ["doc_id", "pred"])
    s = rows.agg(F.sum(F.col("n") * F.col("n") / F.col("pred_n")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("gold_n")).alias("r"), F.sum("n").alias("n"))
    return s.select(*_prf(F.coalesce(F.col("p") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("r") / F.col("n"), F.lit(0.0))))


def cross_document_b_cubed(mentions: DataFrame) -> DataFrame:
    """The same averaged over the mentions of either side; a mention of one side adds nothing. Chains span documents."""
    gold, pred = _sides(mentions)
    both = gold.join(pred, KEYS, "full")
    cells = both.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    sizes = lambda s: both.filter(F.col(s).isNotNull()).groupBy(s).agg(F.count(F.lit(1)).alias(f"{s}_n"))
    rows = cells.filter("gold is not null and pred is not null").join(sizes("gold"), "gold").join(sizes("pred"), "pred")
    hits = rows.agg(F.sum(F.col("n") * F.col("n") / F.col("pred_n")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("gold_n")).alias("r"))
    return hits.join(both.agg(F.count(F.lit(1)).alias("all"))).select(*_prf(F.coalesce(F.col("p") / F.col("all"), F.lit(0.0)), F.coalesce(F.col("r") / F.col("all"), F.lit(0.0))))


def ceaf(mentions: DataFrame, phi: int = 4) -> DataFrame:
    """Greedy one-to-one alignment of chains in each document: phi 3 counts shared mentions, phi 4 twice them over both sizes. Pairs of chains are sorted by document and score and taken in that order."""
    size = lambda s: mentions.filter(F.col("side") == s).groupBy("doc_id", F.col("chain_id").alias(s)).agg(F.count(F.lit(1)).alias(f"{s}_n"))
    pairs = _cells(mentions).join(size("gold"), ["doc_id", "gold"]).join(size("pred"), ["doc_id", "pred"])
    score = F.col("n").cast("double") if phi == 3 else 2 * F.col("n") / (F.col("gold_n") + F.col("pred_n"))

    scored = pairs.select("doc_id", "gold", "pred", score.alias("s"))
    best = one_to_one(scored, "doc_id", [F.desc("s"), F.col("gold"), F.col("pred")], ["gold"], ["pred"]).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("t"))
    weight = F.count(F.lit(1)) if phi == 3 else F.countDistinct("doc_id", "chain_id")
    norm = mentions.groupBy("side").agg(weight.alias("w")).agg(F.max(F.when(F.col("side") == "gold", F.col("w"))).alias("g"), F.max(F.when(F.col("side") == "pred", F.col("w"))).alias("p"))
    return best.join(norm).select(*_prf(_share(F.col("t"), F.col("p")), _share(F.col("t"), F.col("g"))))


def lea(mentions: DataFrame) -> DataFrame:
    """Share of each chain's links found on the other side, weighted by the chain's size; a singleton counts if it is one there too. Common mentions only."""
    cells = _cells(mentions)

    def side(own: str, other: str, name: str) -> DataFrame:
        others = cells.groupBy("doc_id", other).agg(F.sum("n").alias("other_n"))
        chains = cells.join(others, ["doc_id", other]).groupBy("doc_id", own).agg(F.sum("n").alias("size"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("links"), F.max(F.col("other_n") == 1).alias("alone"))
        share = F.when(F.col("size") == 1, F.col("alone").cast("double")).otherwise(F.col("links") / (F.col("size") * (F.col("size") - 1) / 2))
        return chains.agg(F.coalesce(F.sum(F.col("size") * share) / F.sum("size"), F.lit(0.0)).alias(name))

    both = side("pred", "gold", "p").join(side("gold", "pred", "r"))
    return both.select(*_prf(F.col("p"), F.col("r")))


def blanc(mentions: DataFrame) -> DataFrame:
    """Mean of the scores of coreferent and other links between common mentions of a document; under two of them 1."""
    c = _cells(mentions)
    pairs = lambda n: n * (n - 1) / 2
    both = c.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("cc"))
    gold = c.groupBy("doc_id", "gold").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("g"))
    pred = c.groupBy("doc_id", "pred").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("p"))
    all_ = c.groupBy("doc_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("a"))
    x = both.join(gold).join(pred).join(all_)
    f = lambda h, p, g: _share(2 * _share(h, p) * _share(h, g), _share(h, p) + _share(h, g))
    nn = F.col("a") - F.col("p") - F.col("g") + F.col("cc")
    score = lambda a, b: F.when(F.col("a") < 1, 1.0).otherwise((a + b) / 2)
    return x.select(
        score(_share(F.col("cc"), F.col("p")), _share(nn, F.col("a") - F.col("p"))).alias("precision"), score(_share(F.col("cc"), F.col("g")), _share(nn, F.col("a") - F.col("g"))).alias("recall"),
        score(f(F.col("cc"), F.col("p"), F.col("g")), f(nn, F.col("a") - F.col("p"), F.col("a") - F.col("g"))).alias("f1"),
    )


def conll(mentions: DataFrame) -> DataFrame:
    """Mean F1 of MUC, B-cubed and CEAF-e, all from one table of the mentions of each document: cells of gold and predicted chain, with the chains' full sizes.

    Documents that are dealt by doc_id before stay where they are but for the one-to-one choice.
    """
    mine = lambda s: F.col("side") == s
    chain = Window.partitionBy("doc_id", "side", "chain_id").orderBy("start", "end")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = mentions.select("side", *KEYS, "chain_id").withColumns({"n": F.count(F.lit(1)).over(whole), "first": (F.row_number().over(chain) == 1) & F.col("doc_id").isNotNull() & F.col("chain_id").isNotNull()})
    of = lambda s: [F.min(F.when(mine(s), F.struct("chain_id", "n"))).alias(s), F.count_if(mine(s) & F.col("first")).alias(f"{s}_chains")]
    spans = sized.groupBy(*KEYS).agg(*of("gold"), *of("pred"))
    known = F.col("doc_id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    common = (F.col("gold").isNotNull() & F.col("pred").isNotNull() & known).alias("common")
    cells = spans.groupBy("doc_id", common, *(F.col(f"{s}.{c}").alias(a) for s in ("gold", "pred") for c, a in (("chain_id", s), ("n", f"{s}_n")))).agg(F.count(F.lit(1)).alias("n"), F.sum("gold_chains").alias("gold_chains"), F.sum("pred_chains").alias("pred_chains"))
    new = lambda own, other: F.row_number().over(Window.partitionBy("doc_id", "common", own).orderBy(other)) == 1
    both = F.col("common") & F.col("gold").isNotNull() & F.col("pred").isNotNull()
    score = F.when(both, 2 * F.col("n") / (F.col("gold_n") + F.col("pred_n")))
    marked = cells.withColumns({"g1": new("gold", "pred"), "p1": new("pred", "gold"), "s": score})
    chosen = one_to_one(marked, "doc_id", [F.desc_nulls_last("s"), F.col("gold"), F.col("pred")], ["gold"], ["pred"], mark="taken")
    total = lambda c, if_: F.coalesce(F.sum(F.when(if_, c)), F.lit(0))
    n, c = F.col("n"), F.col("common")
    t = chosen.agg(
        total(n, c).alias("n"), F.count_if(c & F.col("gold").isNotNull()).alias("p_parts"), F.count_if(c & F.col("pred").isNotNull()).alias("r_parts"), F.count_if(c & F.col("g1")).alias("gold_met"), F.count_if(c & F.col("p1")).alias("pred_met"),
        total(n, both).alias("linked"), total(n * n / F.col("pred_n"), both).alias("b_p"), total(n * n / F.col("gold_n"), both).alias("b_r"), total(F.col("s"), F.col("taken")).alias("aligned"), F.sum("gold_chains").alias("gold_chains"), F.sum("pred_chains").alias("pred_chains"),
    )
    f1 = lambda p, r: _share(2 * p * r, p + r)
    part = lambda a, b: _share(F.col(a), F.col(b))
    of_links = f1(_share(F.col("n") - F.col("p_parts"), F.col("n") - F.col("pred_met")), _share(F.col("n") - F.col("r_parts"), F.col("n") - F.col("gold_met")))
    return t.select(((of_links + f1(part("b_p", "linked"), part("b_r", "linked")) + f1(part("aligned", "pred_chains"), part("aligned", "gold_chains"))) / 3).alias("f1"))


def purity(mentions: DataFrame) -> DataFrame:
    """Size-weighted share of each predicted chain's largest gold part, and of each gold chain's largest predicted part."""
    c = _cells(mentions)
    side = lambda own, name: c.groupBy("doc_id", own).agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias(name))
    return side("pred", "purity").join(side("gold", "completeness"))


def chains_of_entities(entities: DataFrame, doc: str = "doc_id", entity: str = "ent_idx", canonical: str = "canonical_id") -> DataFrame:
    """Chains by canonical id; an entity without one is a chain of its own."""
    key = F.coalesce(F.concat(F.lit("c"), F.col(canonical)), F.concat(F.lit("e"), F.col(entity)))
    return entities.groupBy(doc, key.alias("chain")).agg(F.count(F.lit(1)).alias("size"), F.min("start").alias("first"), (F.max("start") - F.min("start")).alias("spread"), F.countDistinct(F.lower("text")).alias("variants"))
