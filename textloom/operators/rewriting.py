"""Texts made to stand by themselves: pronouns replaced by what they refer to, before texts are cut and indexed.

What a pronoun refers to is found by running firsts and lasts over the mentions
of a document in order, not by pairing mentions; the replacements of a text are
spliced in by one ordered aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.islands import choose

#: Pronouns by language; reflexive ones; words that may point at something. Fixed values.
PRONOUNS = {
    "en": "he she him her his hers himself herself they them their theirs themselves themself it its itself xe xem xyr xyrs xemself ze hir zir hirs zirs hirself zirself zemself ey em eir eirs emself fae faer faers faeself faerself".split(),
    "fr": "il elle ils elles lui eux leur leurs".split(),
    "es": "él ella ellos ellas lo la los las le les".split(),
    "de": "er sie es ihn ihm ihr ihnen sein seine".split(),
}
REFLEXIVES = "himself herself themselves themself itself xemself hirself zirself zemself emself faeself faerself".split()
DEMONSTRATIVES = ("this", "that", "these", "those")
#: What follows an "it" that refers to nothing: statements about a clause, weather, turns of phrase. Fixed values.
EMPTY_IT = r"^\s*(?:(?:is|was|seems|appears)(?: that | to | .*(?: that | to ))|rain|snow|hail|thunder|pour|drizzle|turns out|turned out|happened that|happens that|follows that|followed that)"
#: Characters between a pronoun and what it refers to, at most; characters after an "it" that are looked at. Fixed values.
REACH, AHEAD = 500, 40


def refers_to_nothing(text: Column, end: Column) -> Column:
    """Whether what follows an "it" that ends at a place shows that it stands for nothing."""
    return F.lower(F.substring(text, end + 1, F.lit(AHEAD))).rlike("(?s)" + EMPTY_IT)


def antecedents(docs: DataFrame, mentions: DataFrame, language: str = "en", reach: int = REACH, cataphora: bool = True, reflexives: bool = False, demonstratives: bool = False) -> DataFrame:
    """Rows (doc_id, start, end, original, replacement, source) for each pronoun among the mentions that refers to something.

    docs: doc_id, text; mentions: doc_id, start, end (characters, half-open),
    text, type, chain (null: none). source is chain: the first mention of the
    pronoun's chain that is no pronoun, wherever it stands; before: the nearest
    such mention of its type that starts before it, if it ends at most reach
    characters before; after: with cataphora, the nearest that starts after it,
    if at most reach characters on. Of mentions with one start the one of greater
    end is the nearer. An "it" that refers to nothing and, unless asked for,
    reflexive pronouns have no row; nor have pronouns with an unknown language.
    A mention without a document, start or end has no part. Of a document's
    repeated rows the text is any one's. Null types fit no type.
    """
    known = [*PRONOUNS.get(language, ()), *(DEMONSTRATIVES if demonstratives else ())]
    low = F.lower("text")
    rows = mentions.filter("doc_id is not null and start is not null and end is not null").select("doc_id", "start", "end", "text", "type", "chain").withColumn("pronoun", low.isin(*known) if known else F.lit(False))
    name = F.when(~F.coalesce("pronoun", F.lit(False)), F.struct("start", "end", "text"))
    order = Window.partitionBy("doc_id", "type").orderBy("start", "end")
    rows = rows.withColumn("before", F.last(name, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("after", F.first(name, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    heads = rows.filter("chain is not null and not pronoun").groupBy("doc_id", "chain").agg(F.min_by("text", F.struct("start", "end", "text")).alias("head"))
    asked = rows.filter("pronoun").join(heads, ["doc_id", "chain"], "left")
    if not reflexives:
        asked = asked.filter(~low.isin(*REFLEXIVES))
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.any_value("text").alias("__text"))
    its = asked.filter(low == "it").join(texts, "doc_id").filter(~refers_to_nothing(F.col("__text"), F.col("end"))).drop("__text")
    asked = asked.filter(low != "it").unionByName(its.select(asked.columns))
    fits = F.col("type").isNotNull()
    by_chain = F.when(F.lower("head") != low, F.col("head"))
    back = F.when(fits & (F.col("start") - F.col("before.end") <= reach), F.col("before.text"))
    ahead = F.when(fits & (F.col("after.start") - F.col("end") <= reach), F.col("after.text")) if cataphora else F.lit(None).cast("string")
    source = F.when(by_chain.isNotNull(), "chain").when(back.isNotNull(), "before").when(ahead.isNotNull(), "after")
    return asked.select("doc_id", "start", "end", F.col("text").alias("original"), F.coalesce(by_chain, back, ahead).alias("replacement"), source.alias("source")).filter("replacement is not null")


def splice(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """docs (doc_id, text) with each text's replacements (doc_id, start, end, original, replacement) put in and rewrites, their number.

    Of replacements that overlap the longest stay, of equals the first by place.
    A replacement starts with a capital where the original does. Ends beyond the
    text are cut to it. Documents without any stay as they are; a null text
    stays null with 0. Rows of one doc_id get the same replacements.
    """
    kept = choose(replacements, ["doc_id"], [F.col("start") - F.col("end"), F.col("start")])
    capital = F.substring("original", 1, 1).rlike(r"^\p{Lu}")
    written = F.when(capital, F.concat(F.upper(F.substring("replacement", 1, 1)), F.expr("substring(replacement, 2)"))).otherwise(F.col("replacement"))
    lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", written.alias("new")))).alias("__r"))
    met = docs.join(lists, "doc_id", "left")

    def step(done: Column, r: Column) -> Column:
        between = F.col("text").substr((done["at"] + 1).cast("int"), (r["start"] - done["at"]).cast("int"))
        return F.struct(r["end"].cast("long").alias("at"), F.concat(done["parts"], F.array(between, r["new"])).alias("parts"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    spliced = F.aggregate("__r", begin, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.col("text").substr((done["at"] + 1).cast("int"), F.length("text"))))
    return met.withColumn("rewrites", F.when(F.col("text").isNotNull(), F.coalesce(F.size("__r"), F.lit(0))).otherwise(0)).withColumn("text", F.when(F.col("__r").isNotNull(), spliced).otherwise(F.col("text"))).drop("__r")


def self_contained(docs: DataFrame, mentions: DataFrame, **options) -> DataFrame:
    """docs with pronouns replaced by what they refer to (``antecedents``, ``splice``) and rewrites, how many of each text."""
    return splice(docs, antecedents(docs, mentions, **options))
