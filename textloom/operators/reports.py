"""Reports over scores and data sets: strata, long tails, gaps over time, out-of-distribution flags, difficulty and discourse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import coref

#: Below what an entity type struggles, and has failed. Fixed values.
STRUGGLING, FAILED = 0.5, 0.01
#: Chains longer than this are long. Fixed value.
LONG_CHAIN = 10


def b_cubed_heads(mentions: DataFrame) -> DataFrame:
    """B-cubed with mentions told by their heads (head_start, head_end); of those of one side with one head the first by place counts, of equal places the one of least chain."""
    first = mentions.groupBy("side", "doc_id", "head_start", "head_end").agg(F.min(F.struct("start", "end", "chain_id")).alias("x"))
    return coref.b_cubed(first.select("side", "doc_id", F.col("head_start").alias("start"), F.col("head_end").alias("end"), "x.chain_id"))


def chain_strata(mentions: DataFrame) -> DataFrame:
    """Rows (stratum, gold_chains, f1): LEA over the chains of either side of one size class: long (over LONG_CHAIN mentions), short, singleton; a stratum without chains has 0."""
    by = Window.partitionBy("side", "doc_id", "chain_id")
    sized = mentions.withColumn("stratum", F.when(F.count(F.lit(1)).over(by) > LONG_CHAIN, "long").when(F.count(F.lit(1)).over(by) > 1, "short").otherwise("singleton"))
    out = None
    for name in ("long", "short", "singleton"):
        own = sized.filter(F.col("stratum") == name)
        gold = own.filter("side = 'gold'").agg(F.countDistinct("doc_id", "chain_id").alias("gold_chains"))
        row = gold.join(coref.lea(own.drop("stratum")).select("f1")).select(F.lit(name).alias("stratum"), "gold_chains", F.coalesce("f1", F.lit(0.0)).alias("f1"))
        out = row if out is None else out.unionByName(row)
    return out


def zero_anaphors(mentions: DataFrame) -> DataFrame:
    """One row (tp, wrong_link, fp, fn, gold_anaphors, pred_anaphors) over mentions without extent (start = end) of either side.

    A mention is anaphoric on a side if its chain there has a mention that
    ends at or before its start. tp: one of these is common to both sides.
    """
    zero = mentions.filter("start = end").select("doc_id", "start", "end").distinct()
    def before(side: str) -> DataFrame:
        own = mentions.filter(F.col("side") == side).select("doc_id", "chain_id", "start", "end").distinct()
        at = zero.join(own, ["doc_id", "start", "end"])
        prior = own.select("doc_id", "chain_id", F.col("start").alias("s"), F.col("end").alias("e"))
        return at.join(prior, ["doc_id", "chain_id"]).filter((F.col("e") <= F.col("start")) & ~((F.col("s") == F.col("start")) & (F.col("e") == F.col("end")))).select("doc_id", "start", "end", "s", "e").distinct()

    gold, pred = before("gold"), before("pred")
    count = lambda df, name: df.groupBy("doc_id", "start", "end").agg(F.count(F.lit(1)).alias(name))
    both = zero.join(count(gold, "g"), ["doc_id", "start", "end"], "left").join(count(pred, "p"), ["doc_id", "start", "end"], "left").join(count(gold.join(pred, ["doc_id", "start", "end", "s", "e"]), "c"), ["doc_id", "start", "end"], "left")
    g, p, c = (F.col(x).isNotNull() for x in "gpc")
    return both.agg(F.count_if(g & p & c).alias("tp"), F.count_if(g & p & ~c).alias("wrong_link"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("gold_anaphors"), F.count_if((g | ~g) & p).alias("pred_anaphors"))


def long_tail_report(types: DataFrame) -> DataFrame:
    """One row over types (class, part, f1): unweighted mean F1 of head, mid and tail, gap of head and tail, Gini of F1, and how many struggle or have failed. No type: zeros."""
    mean = lambda part: F.coalesce(F.avg(F.when(F.col("part") == part, F.col("f1"))), F.lit(0.0))
    place = Window.orderBy("f1", "class")  # a row for each type
    ranked = types.withColumn("__k", F.row_number().over(place))
    n, total = F.count(F.lit(1)), F.sum("f1")
    gini = F.when((n == 0) | (total == 0), 0.0).otherwise((2 * F.sum(F.col("__k") * F.col("f1")) - (n + 1) * total) / (n * total))
    return ranked.agg(mean("head").alias("head_f1"), mean("mid").alias("mid_f1"), mean("tail").alias("tail_f1"), (mean("head") - mean("tail")).alias("head_tail_gap"), F.coalesce(gini, F.lit(0.0)).alias("gini"), F.count_if(F.col("f1") < STRUGGLING).alias("struggling"), F.count_if(F.col("f1") < FAILED).alias("failed"))


def decade_gaps(names: DataFrame) -> DataFrame:
    """Rows (decade, n, rate, rate_f, rate_m, gap) over names (decade, gender, recognised): recognition by decade, and the gap of the genders where both are known."""
    rate = lambda c: F.avg(c.cast("double"))
    of = lambda g: rate(F.when(F.col("gender") == g, F.col("recognised")))
    return names.groupBy("decade").agg(F.count(F.lit(1)).alias("n"), rate(F.col("recognised")).alias("rate"), of("f").alias("rate_f"), of("m").alias("rate_m"), F.abs(of("f") - of("m")).alias("gap"))


def shots_summary(runs: DataFrame) -> DataFrame:
    """Rows (shots, tasks, mean, std): sample deviation of the F1 of tasks with so many examples; one task: 0."""
    return runs.groupBy("shots").agg(F.count(F.lit(1)).alias("tasks"), F.avg("f1").alias("mean"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("std"))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a lower-case text; a shorter text is its own."""
    low = F.lower(text)
    return F.when(F.length(low) <= n, F.array(low)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))))


def out_of_distribution(test: DataFrame, train: DataFrame, text: str = "text", confidence: str = "confidence", least_coverage: float = 0.5, least_confidence: float = 0.5, n: int = 3) -> DataFrame:
    """test (id, text, confidence) with coverage, the share of its n-grams that train has, and flags: low_vocab_coverage, unseen_entity (unknown text of a coverage under 0.8), low_confidence, unusual_characters (control or private characters)."""
    known = train.select(F.explode(ngrams(F.col(text), n)).alias("g")).distinct().withColumn("__in", F.lit(1))
    grams = test.select("id", F.explode(ngrams(F.col(text), n)).alias("g")).join(known, "g", "left").groupBy("id").agg((F.count("__in") / F.count(F.lit(1))).alias("coverage"))
    seen = train.select(F.lower(text).alias("__low")).distinct().withColumn("__seen", F.lit(True))
    met = test.join(grams, "id", "left").fillna(1.0, ["coverage"]).withColumn("__low", F.lower(text)).join(seen, "__low", "left")
    flag = lambda test_, name: F.when(test_, name)
    flags = F.array_compact(F.array(
        flag(F.col("coverage") < least_coverage, "low_vocab_coverage"), flag(F.col("__seen").isNull() & (F.col("coverage") < 0.8), "unseen_entity"),
        flag(F.col(confidence) < least_confidence, "low_confidence"), flag(F.col(text).rlike(r"[\p{Cc}\p{Co}\x{FFFD}]"), "unusual_characters"),
    ))
    return met.withColumn("flags", flags).drop("__low", "__seen")


def out_of_distribution_report(flagged: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: entities, how many have a flag, their share, and the mean confidence of those with and without."""
    ood = F.size("flags") > 0
    mean = lambda test: F.coalesce(F.avg(F.when(test, F.col(confidence))), F.lit(0.0))
    return flagged.agg(F.count(F.lit(1)).alias("entities"), F.count_if(ood).alias("ood"), F.coalesce(F.avg(ood.cast("double")), F.lit(0.0)).alias("ood_rate"), mean(ood).alias("ood_confidence"), mean(~ood).alias("id_confidence"))


def annotation_stats(entities: DataFrame, examples: DataFrame) -> DataFrame:
    """One row over entities (doc_id, label, text) and the examples they are in: types, entities an example, mean and population deviation of words an entity, share of distinct lower-case entities."""
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    own = entities.agg(F.countDistinct("label").alias("types"), F.count(F.lit(1)).alias("entities"), F.avg(words).alias("length_mean"), F.stddev_pop(words).alias("length_std"), (F.countDistinct(F.lower("text")) / F.count(F.lit(1))).alias("diversity"))
    return own.join(examples.agg(F.count(F.lit(1)).alias("examples"))).withColumn("per_example", F.col("entities") / F.col("examples"))


def difficulty(stats: DataFrame) -> DataFrame:
    """stats of ``annotation_stats`` with a heuristic score (0 to 1) and its class: easy under 0.2, medium under 0.4, hard under 0.6, else very hard."""
    t, d = F.col("types"), F.col("diversity")
    score = F.when(t > 10, 0.2).when(t > 5, 0.1).otherwise(0.0) + F.when(F.col("length_mean") > 3, 0.2).otherwise(0.0) + F.when(F.col("length_std") > 2, 0.1).otherwise(0.0)
    score = F.round(score + F.when(d > 0.9, 0.2).when(d < 0.3, -0.1).otherwise(0.0) + F.when(F.col("per_example") < 1, 0.1).otherwise(0.0), 6)
    level = F.when(score < 0.2, "easy").when(score < 0.4, "medium").when(score < 0.6, "hard").otherwise("very hard")
    return stats.withColumns({"score": F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), "difficulty": level})


def compare_vocabularies(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """One row: Jaccard overlap of the lower-case words of two sets of texts, and the difference of their mean words a text."""
    words = lambda df: F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    vocabulary = lambda df, side: df.select(F.explode(words(df)).alias("w")).distinct().withColumn(side, F.lit(1))
    shared = vocabulary(a, "x").join(vocabulary(b, "y"), "w", "full").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
    mean = lambda df, name: df.agg(F.coalesce(F.avg(F.size(words(df))), F.lit(0.0)).alias(name))
    return shared.join(mean(a, "p")).join(mean(b, "q")).select(F.coalesce(F.col("shared") / F.col("either"), F.lit(0.0)).alias("vocabulary_overlap"), (F.col("p") - F.col("q")).alias("length_difference"))


#: Words that stand for something said before, as they are counted. Fixed values.
ANAPHORS = ("this ", "that ", "these ", "those ", "this.", "that.", "this,", "that,", " it ", " it.", " it,")


def discourse_counts(docs: DataFrame, shell_nouns: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, anaphors, shell_nouns, sentences) of each text: how often ANAPHORS occur, words of a list (noun), and sentence ends, at least one."""
    low = F.lower(text)
    count = lambda p: (F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)
    total = count(ANAPHORS[0])
    for p in ANAPHORS[1:]:
        total = total + count(p)
    own = docs.select(F.col(doc_id).alias("doc_id"), total.cast("long").alias("anaphors"), F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+(?:\s|$)"), F.lit(0))), F.lit(1)).alias("sentences"))
    nouns = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(low, r"[^\p{L}]+")).alias("noun")).join(shell_nouns, "noun").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shell_nouns"))
    return own.join(nouns, "doc_id", "left").fillna(0, ["shell_nouns"])


def agreement(votes: DataFrame, key: str = "item", label: str = "label") -> DataFrame:
    """One row over votes: items, the share whose votes all agree, and of pairs of votes on an item the share that agrees."""
    cells = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    return items.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("labels") == 1).cast("double")).alias("unanimous"), (F.sum("same") / F.sum(F.col("votes") * (F.col("votes") - 1))).alias("pair_agreement"))


def label_overlap(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """One row: Jaccard of two sets of labels; two empty ones: 1."""
    both = a.select(label).distinct().withColumn("x", F.lit(1)).join(b.select(label).distinct().withColumn("y", F.lit(1)), label, "full")
    return both.agg(F.coalesce(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count(F.lit(1)), F.lit(1.0)).alias("overlap"))


def domain_shift(test: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """One row: words of test, the share, by occurrence and by distinct word, that train lacks."""
    words = lambda df: df.select(F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")).alias("w"))
    counted = words(test).groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(words(train).distinct().withColumn("__in", F.lit(1)), "w", "left")
    return counted.agg(F.sum("n").alias("words"), (F.sum(F.when(F.col("__in").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov_rate"), (F.count_if(F.col("__in").isNull()) / F.count(F.lit(1))).alias("oov_types"))
