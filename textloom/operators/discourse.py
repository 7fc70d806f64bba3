"""Sentences and clauses, centres of utterances, coreference by rules, events, zero mentions, tag models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.strings import PRONOUNS
from textloom.operators.resolve import components
from textloom.storage import stash

#: Cue words of quantified mentions, and of approximate ones. Fixed values.
QUANTIFIERS = {"universal": ("all", "every", "each"), "negative": ("no", "none"), "existential": ("some", "several", "a few", "many"), "bare_plural": ("most",)}
APPROXIMATE = ("about", "around", "approximately", "roughly", "nearly", "almost")
#: Suffixes of gendered pronouns: what a pronoun may stand for. Fixed values.
PRONOUN_TYPES = {"he": "PER", "him": "PER", "his": "PER", "she": "PER", "her": "PER", "hers": "PER", "it": "ORG", "its": "ORG", "they": "ANY", "them": "ANY", "their": "ANY"}


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, text): sentences of a text, ended by . ! ? before white space, a CJK stop, or a line end."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("idx", "text"))


def clauses(sentence_rows: DataFrame) -> DataFrame:
    """(doc_id, idx, clause, text): sentences cut at commas, semicolons and joining words."""
    parts = F.filter(F.split("text", r"[,;:]\s+|\s+(?=(?:because|although|while|which|but|and then)\b)"), lambda x: F.trim(x) != "")
    return sentence_rows.select("doc_id", "idx", F.posexplode(parts).alias("clause", "text"))


def quantifier(before: Column) -> Column:
    """The kind of the cue word that ends the text before a mention."""
    end = lambda words: F.lower(before).rlike(r"\b(" + "|".join(words) + r")\s*$")
    return F.coalesce(*(F.when(end(words), kind) for kind, words in QUANTIFIERS.items()), F.when(end(APPROXIMATE), "approximate"))


def centering(utterances: DataFrame, doc: str, order: str, centres: str) -> DataFrame:
    """utterances (ranked centres as an array) with the backward centre - the first centre of the one before that is present here - and the transition: continue, retain, smooth_shift, rough_shift; none where there is no backward or preferred centre."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = utterances.withColumn("__p", F.lag(centres).over(w))
    shared = F.filter("__p", lambda c: F.array_contains(centres, c))
    rows = rows.withColumn("cb", F.try_element_at(shared, F.lit(1))).withColumn("cp", F.try_element_at(centres, F.lit(1)))
    rows = rows.withColumn("__b", F.lag("cb").over(w))
    same = F.col("__b").isNull() | (F.col("__b") == F.col("cb"))
    move = F.when(F.col("cb").isNull() | F.col("cp").isNull(), None).when(same, F.when(F.col("cb") == F.col("cp"), "continue").otherwise("retain")).otherwise(F.when(F.col("cb") == F.col("cp"), "smooth_shift").otherwise("rough_shift"))
    return rows.withColumn("transition", move).drop("__p", "__b")


def coherence(transitions: DataFrame, doc: str) -> DataFrame:
    """How often each transition stands in a document."""
    return transitions.filter("transition is not null").groupBy(doc).agg(*(F.count_if(F.col("transition") == t).alias(t) for t in ("continue", "retain", "smooth_shift", "rough_shift")))


def _acronym(text: Column) -> Column:
    """First letters of the words that begin with a capital."""
    capital = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.array_join(F.transform(capital, lambda w: F.substring(w, 1, 1)), "")


def resolve(mentions: DataFrame, doc: str = "doc_id", lookback: int = 10) -> DataFrame:
    """(doc, idx, chain) of the mentions (doc, idx, text, type) of documents; chain is the place, from 0, of the chain's first mention in order of idx.

    Mentions of one document and type that are no pronouns are one chain if
    connected by equal text (case apart), one being the other's acronym, for PER
    an equal last word, or one's words standing in a row in the other's. A pronoun
    joins the chain of the nearest such mention of a fitting type among the
    lookback mentions before it, else it begins one. Null and blank texts, and
    pronouns that fit none, are chains of their own; a null type is a type, and a
    null doc a document. Ties in idx go by text, then type. All relations are
    joins on equal keys, each tied to its least place, so no document is paired
    off; a mention of n words has n (n + 1) / 2 rows of words in a row.
    """
    order = Window.partitionBy("d").orderBy("idx", "text", "type")
    low, key = F.lower("text"), ["d", "type"]
    rows = stash(mentions.select(F.struct(F.col(doc).alias("doc")).alias("d"), F.col("idx").cast("long").alias("idx"), "text", F.coalesce(F.col("type"), F.lit("")).alias("type")).withColumn("pos", (F.row_number().over(order) - 1).cast("long")), "mentions")
    name = F.coalesce((F.trim("text") != "") & ~low.isin(*PRONOUNS), F.lit(False))
    forms = stash(rows.filter(name).groupBy(*key, "text").agg(F.min("pos").alias("pos")).withColumn("low", low), "forms")

    def tied(by: DataFrame) -> DataFrame:
        """Places of equal key (by: d, type, w, pos) with the least of them."""
        least = by.groupBy(*key, "w").agg(F.min("pos").alias("a"))
        return by.join(least, [*key, "w"]).filter("a <> pos").select("d", "a", F.col("pos").alias("b"))

    last = forms.filter("type = 'PER'").select(*key, F.element_at(F.split(F.trim("low"), r"\s+"), -1).alias("w"), "pos")
    short = forms.select(*key, F.col("text").alias("w"), F.col("pos").alias("a"))
    long = forms.select(*key, _acronym(F.col("text")).alias("w"), F.col("pos").alias("b"))
    words = F.split("low", " ")
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    parts = forms.select(*key, F.explode(F.array_distinct(starts)).alias("w"), F.col("pos").alias("b"))
    whole = forms.groupBy(*key, F.col("low").alias("w")).agg(F.min("pos").alias("a"))
    links = tied(forms.select(*key, F.col("low").alias("w"), "pos")).unionByName(tied(last)).unionByName(short.join(long, [*key, "w"]).select("d", "a", "b")).unionByName(whole.join(parts, [*key, "w"]).filter("a <> b").select("d", "a", "b"))
    found = components(links.select(F.struct("d", F.col("a").alias("pos")).alias("a"), F.struct("d", F.col("b").alias("pos")).alias("b")))
    of_form = forms.join(found.select("node.d", "node.pos", F.col("cluster.pos").alias("root")), ["d", "pos"], "left").select(*key, "text", F.coalesce("root", "pos").alias("root"))
    named = rows.join(of_form, [*key, "text"], "left")
    near = Window.partitionBy("d").orderBy("pos").rowsBetween(-lookback, -1)
    latest = {t: F.last(F.when(F.col("root").isNotNull() & (F.lit(t == "ANY") | (F.col("type") == t)), F.col("root")), True).over(near) for t in set(PRONOUN_TYPES.values())}
    wanted = F.coalesce(*(F.when(low.isin([w for w, k in PRONOUN_TYPES.items() if k == t]), latest[t]) for t in sorted(latest)))
    chained = named.withColumn("chain", F.coalesce("root", wanted, "pos"))
    return chained.select(F.col("d.doc").alias(doc), "idx", "chain")


def event_clusters(events: DataFrame, doc: str = "doc_id", least: float = 0.3) -> DataFrame:
    """(doc, idx, cluster): each free event (doc, idx, trigger, type, args) seeds a cluster and takes the later free ones of its type with an equal trigger or enough shared arguments with the seed; not transitive. Null triggers equal none, null arguments are none, a null type is a type. Seeds are tried in order, so a document's events are one task's, by type."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        got: dict[int, int] = {}
        items = [(i, t.lower() if isinstance(t, str) else None, set() if a is None else set(a)) for i, t, a in zip(rows["idx"], rows["trigger"], rows["args"], strict=True)]
        for k, (i, trigger, args) in enumerate(items):
            if k in got:
                continue
            got[k] = i
            for j, (_, other, args2) in enumerate(items[k + 1 :], k + 1):
                union = args | args2
                if j not in got and ((trigger is not None and trigger == other) or (union and len(args & args2) / len(union) >= least)):
                    got[j] = i
        return pd.DataFrame({doc: [key[0]] * len(items), "idx": rows["idx"].tolist(), "cluster": [got[k] for k in range(len(items))]})

    kind = events.schema[doc].dataType.simpleString()
    return events.select(doc, F.col("idx").cast("long").alias("idx"), "trigger", "type", "args").groupBy(doc, "type").applyInPandas(one, f"{doc} {kind}, idx long, cluster long")


def tag_counts(tokens: DataFrame, doc: str, position: str, token: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Transition (prev, tag, n) and emission (tag, token, n) counts for a tag model; the one before the first is START."""
    w = Window.partitionBy(doc).orderBy(position)
    rows = tokens.withColumn("prev", F.coalesce(F.lag(tag).over(w), F.lit("START")))
    return rows.groupBy("prev", F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n")), rows.groupBy(F.col(tag).alias("tag"), F.lower(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def decode_tags(tokens: DataFrame, transitions: dict[tuple[str, str], float], emissions: dict[tuple[str, str], float], doc: str, position: str, token: str, floor: float = -12.0) -> DataFrame:
    """(doc, position, tag) of the best tag path by log-probabilities; unseen pairs have the floor. The model has a row for each pair of tags and each known word."""
    tags = sorted({t for _, t in transitions})

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position, kind="stable")
        score, back = {"START": 0.0}, []
        for w in rows[token].str.lower():
            best = {t: max((s + transitions.get((p, t), floor), p) for p, s in score.items()) for t in tags}
            back.append({t: p for t, (_, p) in best.items()})
            score = {t: s + emissions.get((t, w), floor) for t, (s, _) in best.items()}
        at, out = max(score, key=lambda t: (score[t], t)), []
        for step in reversed(back):
            out.append(at)
            at = step[at]
        return pd.DataFrame({doc: [key[0]] * len(out), position: rows[position].tolist(), "tag": out[::-1]})

    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in (doc, position))
    return tokens.select(doc, position, token).groupBy(doc).applyInPandas(one, f"{kinds}, tag string")
