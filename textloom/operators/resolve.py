"""Cross-document entities: links of similar mentions without pairing off common words, and their connected clusters.

Two mentions are alike if the Jaccard similarity of their word sets reaches a
threshold. Sets are written with their rare words first. If two sets of sizes m
and n are alike they share at least ``needed`` words, so for every number j of
words up to that, their first j common words stand among the first m - needed +
j of one and the same count of the other. Keys are therefore tuples of leading
words, at first of one. A key that more than BLOCK sets have is not paired off:
they are compared with one of them, and unless that connects them all they go on
with one word more. Where a key is so long that sets of two sizes must be alike,
each is tied to the least of the lesser size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import drop_stash, stash

#: Sets of a key that are paired off with one another; a key of more is lengthened.
BLOCK = 64
#: The similarity from which mentions are one entity, unless the caller says otherwise. Fixed value.
LEAST = 0.7


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, cluster): cluster is the least node that links reach; nodes of no link to another have no row.

    Links may repeat, run either way and be loops; one with a null end is none.
    Each round ties every node's greater neighbours, then its lesser ones and
    itself, to the least around it, by two grouped minima joined back to the
    links: a node with many links is split by the join, not gathered. Rounds
    grow with the logarithm of the longest path; their links are written to the
    shared folder. An empty table gives no rows.
    """
    now = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("u", "v", "k").filter("k and u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stash(small, "links")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = after
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())


def words(text: Column) -> Column:
    """The set of a text's words in lower case, without 's or ' at their ends, sorted; null and blank texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "('s|’s)*'*$", "")), lambda w: w != "")))


def _similarity(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return F.try_divide(shared, F.size(x) + F.size(y) - shared)


def _needed(size: Column, least: float) -> Column:
    """Words that a set of this size shares with any that is alike."""
    return F.ceil(F.lit(least) * size - F.lit(1e-9)).cast("int")


def _proven(size: Column, other: Column, shared: int, least: float) -> Column:
    """Whether sets of two sizes are alike because they share so many words."""
    return F.lit(float(shared)) / (size + other - shared) >= least - 1e-9


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) with their sets x and y those that are alike."""
    return pairs.filter(_similarity(F.col("x"), F.col("y")) >= least - 1e-9).select("a", "b")


def set_links(sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of sets (id, kind, words) with equal kind and a Jaccard similarity of at least ``least`` (above 0).

    Ids are unique; words hold no repeats. Empty sets link to nothing. Every link
    is verified on the whole sets, but those within a key that proves itself.
    """
    freq = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = sets.select("id", "kind", F.explode("words").alias("w")).join(freq, "w").groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("words"))
    ranked = stash(ranked.withColumn("size", F.size("words")).withColumn("need", _needed(F.col("size"), least)), "sets")
    most = ranked.agg(F.max("size")).first()[0] or 0
    fields = ["id", "kind", "size", "need", "words"]
    # a key: words taken so far, and the place after the last of them
    firsts = ranked.select(*fields, F.explode(F.sequence(F.lit(0), F.col("size") - F.col("need"))).alias("at"))
    keys = stash(firsts.select(*fields, F.array(F.get("words", F.col("at"))).alias("key"), (F.col("at") + 1).alias("next")), "keys")
    links = stash(ranked.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")), "pairs")
    for taken in range(1, most + 1):
        counts = stash(keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).filter("n > 1"), "counts")
        few = keys.join(counts.filter(f"n <= {block}").select("kind", "key"), ["kind", "key"]).select("kind", "key", "id", "words")
        x, y = few.select("kind", "key", F.col("id").alias("a"), F.col("words").alias("x")), few.select("kind", "key", F.col("id").alias("b"), F.col("words").alias("y"))
        found = links.unionByName(_alike(x.join(y, ["kind", "key"]).filter("a < b"), least))
        many = stash(keys.join(counts.filter(f"n > {block}").select("kind", "key", "a"), ["kind", "key"]), "many")
        more = not many.isEmpty()
        if more:
            heads = ranked.select(F.col("id").alias("a"), F.col("words").alias("x"))
            found = found.unionByName(_alike(many.filter("a <> id").select("a", F.col("id").alias("b"), F.col("words").alias("y")).join(heads, "a"), least))
            # what shares so many words that its sizes make it alike is tied to the least set of each lesser or equal size
            centres = many.groupBy("kind", "key", F.col("size").alias("m")).agg(F.min("id").alias("c"))
            sure = many.select("kind", "key", "size", F.col("id").alias("b")).join(centres, ["kind", "key"]).filter((F.col("m") <= F.col("size")) & _proven(F.col("size"), F.col("m"), taken, least) & (F.col("b") != F.col("c")))
            found = found.unionByName(sure.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")))
        links, before = stash(found.distinct(), "pairs"), links
        drop_stash(before)
        if not more:
            break
        # a key whose sets are connected already has nothing to add; nor has a set that no other of its key can be alike to, or must be
        rooted = many.drop("a").join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("cluster", "id"))
        mixed = rooted.groupBy("kind", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_set("size").alias("sizes")).filter("low < high").select("kind", "key", "sizes")
        size = F.col("size")
        open_to = F.exists("sizes", lambda m: (F.least(size, m) >= F.lit(least) * F.greatest(size, m) - 1e-9) & ~_proven(size, m, taken, least))
        longer = rooted.filter(size > taken).join(mixed, ["kind", "key"]).filter(open_to).select(*fields, "key", "next")
        longer = longer.filter("next < size").withColumn("at", F.explode(F.sequence("next", F.least(size - F.col("need") + taken, size - 1))))
        after = stash(longer.select(*fields, F.concat("key", F.array(F.get("words", F.col("at")))).alias("key"), (F.col("at") + 1).alias("next")), "keys")
        for done in (keys, many, counts):
            drop_stash(done)
        keys = after
    return links


def entities(mentions: DataFrame, least: float = LEAST, match_type: bool = True, block: int = BLOCK) -> DataFrame:
    """mentions (id, text, type, doc_id) with cluster (the least id of its entity), name (that mention's text) and documents (how many different ones the entity is in).

    Mentions are one entity if links of similar word sets (and, with match_type,
    equal types; null types equal each other) connect them. Mentions of equal
    words and type are one set however many they are; a mention without words is
    an entity of its own with others like it of its type. A null id is a mention
    of no cluster: its cluster, name and documents are null. Repeated ids are
    repeated rows of one mention.
    """
    kind = F.coalesce(F.concat(F.lit("="), F.col("type")), F.lit("-")) if match_type else F.lit("")
    own = mentions.select("id", "doc_id", "text", kind.alias("kind"), words(F.col("text")).alias("words"), F.sha2(F.concat_ws("\n", kind, F.array_join(words(F.col("text")), " ")), 256).alias("form"))
    forms = stash(own.filter("id is not null").groupBy("form", "kind").agg(F.min("id").alias("id"), F.any_value("words").alias("words")), "forms")
    roots = components(set_links(forms.select("id", "kind", "words"), least, block))
    of_form = forms.join(roots.withColumnRenamed("node", "id"), "id", "left").select("form", F.coalesce("cluster", "id").alias("cluster"))
    placed = own.join(of_form, "form", "left").withColumn("cluster", F.when(F.col("id").isNotNull(), F.col("cluster")))
    about = placed.filter("cluster is not null").groupBy("cluster").agg(F.min_by("text", "id").alias("name"), F.countDistinct("doc_id").alias("documents"))
    extra = placed.select("id", "form", "cluster").filter("id is not null").dropDuplicates(["id", "form"]).join(about, "cluster").drop("form")
    return mentions.join(extra.dropDuplicates(["id"]), "id", "left")
