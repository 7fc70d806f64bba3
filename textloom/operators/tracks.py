"""Tracks and identities of a document's signals, tag repair, candidate spans, offsets through substitutions, and graphs made of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked(tracks: DataFrame) -> DataFrame:
    """Tracks with an identity."""
    return tracks.filter("identity_id is not null")


def unlinked(tracks: DataFrame) -> DataFrame:
    """Tracks without one."""
    return tracks.filter("identity_id is null")


def document_stats(signals: DataFrame, track_signals: DataFrame, tracks: DataFrame) -> DataFrame:
    """For each document of signals (doc_id, signal_id, confidence, negated, modality): counts of signals, tracks (doc_id, track_id, identity_id) and identities, of signals of no track, mean size and singletons of tracks, mean confidence, and counts by modality."""
    of = lambda m: F.count_if(F.col("modality") == m).alias(f"{m}_count")
    own = signals.groupBy("doc_id").agg(F.count(F.lit(1)).alias("signal_count"), F.avg("confidence").alias("avg_confidence"), F.count_if("negated").alias("negated_count"), of("symbolic"), of("iconic"), of("hybrid"))
    loose = signals.join(track_signals.select("doc_id", "signal_id").distinct(), ["doc_id", "signal_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("untracked_count"))
    sizes = tracks.join(track_signals.groupBy("doc_id", "track_id").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "track_id"], "left").fillna(0, ["n"])
    grouped = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("track_count"), F.countDistinct("identity_id").alias("identity_count"), F.count("identity_id").alias("linked_track_count"), F.avg("n").alias("avg_track_size"), F.count_if(F.col("n") == 1).alias("singleton_count"))
    counts = ["untracked_count", "track_count", "identity_count", "linked_track_count", "avg_track_size", "singleton_count"]
    return own.join(loose, "doc_id", "left").join(grouped, "doc_id", "left").fillna(0, counts)


def merge_tracks(track_signals: DataFrame, tracks: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """track_signals (track_id, position, signal_id) and tracks (track_id, surface, type) after merging groups (target, track_id, place).

    A merged track holds the signals of its parts by old position, then place,
    renumbered from 0, and the surface and type of the first part, by place,
    that has signals. Parts go; a group without signals leaves no track.
    """
    moved = track_signals.join(groups, "track_id")
    order = Window.partitionBy("target").orderBy("position", "place", "signal_id")
    signals = moved.select(F.col("target").alias("track_id"), (F.row_number().over(order) - 1).alias("position"), "signal_id")
    held = moved.groupBy("target", "track_id", "place").agg(F.count(F.lit(1)).alias("n"))
    first = held.join(tracks, "track_id").groupBy("target").agg(F.min_by(F.struct("surface", "type"), "place").alias("x")).select(F.col("target").alias("track_id"), "x.*")
    rest = lambda df: df.join(groups.select("track_id"), "track_id", "left_anti")
    return rest(track_signals).unionByName(signals), rest(tracks).unionByName(first)


def repair_tags(tags: DataFrame, scheme: str, discard: bool = False, doc: str = "doc_id", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """tags with the tag repaired in a sequence: what may not stand where it does begins an entity (B-, or S- in IOBES), or becomes O if discard.

    IOB2: an I- after O or another type. IOBES: an I- or E- that no B- begins.
    A repaired tag counts as the one before the next, which makes a rule over
    runs: the tags that go on from a wrong one are as wrong as it, if discarded.
    """
    by = Window.partitionBy(doc).orderBy(pos)
    mark, kind = F.substring(tag, 1, 1), F.when(F.col(tag).rlike("^[A-Z]-"), F.substring(tag, 3, 1 << 20))
    if scheme == "IOBES":
        before = F.last(F.when(mark != "I", mark), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
        wrong = mark.isin("I", "E") & (F.coalesce(before, F.lit("O")) != "B")
        new = F.lit("O") if discard else F.concat(F.lit("S-"), kind)
        return tags.withColumn("__w", wrong).withColumn(tag, F.when(F.col("__w"), new).otherwise(F.col(tag))).drop("__w")
    marked = tags.withColumns({"__m": mark, "__k": kind}).withColumns({"__p": F.lag("__m").over(by), "__q": F.lag("__k").over(by)})
    wrong = (F.col("__m") == "I") & (F.coalesce(F.col("__p"), F.lit("O")).eqNullSafe("O") | ~F.col("__k").eqNullSafe(F.col("__q")))
    marked = marked.withColumn("__w", wrong)
    if discard:  # a run of I- is as wrong as its first
        starts = F.when((F.col("__m") != "I") | F.col("__w"), F.col("__w"))
        marked = marked.withColumn("__w", F.last(starts, ignorenulls=True).over(by) & (F.col("__m") == "I"))
    new = F.lit("O") if discard else F.concat(F.lit("B-"), F.col("__k"))
    return marked.withColumn(tag, F.when(F.col("__w"), new).otherwise(F.col(tag))).drop("__m", "__k", "__p", "__q", "__w")


def span_candidates(docs: DataFrame, widest: int, tokens: str = "n_tokens") -> DataFrame:
    """Rows (doc_id, start, end) of every span of at most `widest` tokens of each document."""
    starts = docs.filter(F.col(tokens) > 0).select("doc_id", F.col(tokens).alias("__n"), F.explode(F.sequence(F.lit(0), F.col(tokens) - 1)).alias("start"))
    return starts.select("doc_id", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + widest, F.col("__n")))).alias("end"))


def filtered_candidates(docs: DataFrame, mask: DataFrame, widest: int, least: float, tokens: str = "n_tokens") -> DataFrame:
    """The candidates whose first token has a mask (doc_id, pos, weight) of at least `least`."""
    good = mask.filter(F.col("weight") >= least).select("doc_id", F.col("pos").alias("start"))
    return span_candidates(docs, widest, tokens).join(good, ["doc_id", "start"], "left_semi")


def translate_span(start: Column, end: Column, subs: Column) -> Column:
    """A span of the raw text in the text after substitutions (raw_start, raw_end, pseudo_start, pseudo_end; in order, apart): within one, its span; partly over one, null; else moved by what those before it added."""
    over = F.filter(subs, lambda s: (s.raw_end > start) & (s.raw_start < end))
    first = F.get(over, F.lit(0))
    added = F.aggregate(F.filter(subs, lambda s: s.raw_end <= start), F.lit(0).cast("long"), lambda t, s: t + (s.pseudo_end - s.pseudo_start) - (s.raw_end - s.raw_start))
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    inside = (first.raw_start <= start) & (first.raw_end >= end)
    return F.when(F.size(over) == 0, span(F.greatest(start + added, F.lit(0)), F.greatest(end + added, F.lit(0)))).when(inside, span(first.pseudo_start, first.pseudo_end))


#: Before a person's name, and after an organisation's. Fixed values.
HONORIFICS = ("monsieur ", "madame ", "m. ", "mme ", "mlle ")
LEGAL_FORMS = (" SAS", " SARL", " SA", " SCI", " SCS", " SCP", " EURL", " SASU", " SNC", " sas", " sarl", " sa", " sci")


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def party_form(raw: Column) -> Column:
    """person:last_first for a name after an honorific (the last word in capitals is the last name, else the last word), else org:name without "société" before it, legal forms, each once, and what follows "au capital"."""
    plain = F.trim(raw)
    person = F.lower(plain).rlike("^(?:" + "|".join(h.replace(".", r"\.") for h in HONORIFICS) + ")")
    words = F.filter(F.split(F.regexp_replace(plain, "^(?:Monsieur|Madame|M\\.|Mme|Mlle) ", ""), r"\s+"), lambda w: w != "")
    capitals = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), ((F.upper(w) == w) & w.rlike(r"\p{L}")).alias("up"))), lambda x: x.up)
    at = F.when(F.size(capitals) > 0, F.element_at(capitals, -1).i).otherwise(F.size(words) - 1)
    last = F.get(words, at)
    first = F.array_join(F.filter(words, lambda w, i: i != at), " ")
    name = F.regexp_replace(plain, "(?i)^soci[eé]t[eé] ", "")
    without = lambda t, form: F.when(F.position(form, t) > 0, F.concat(F.substring(t, F.lit(1), F.position(form, t) - 1), F.substring(t, F.position(form, t) + F.length(form), F.length(t)))).otherwise(t)
    name = F.aggregate(F.array(*map(F.lit, LEGAL_FORMS)), name, without)
    name = F.regexp_replace(name, "(?is) au capital .*$", "")
    who = F.concat(F.lit("person:"), _slug(last), F.when(first != "", F.concat(F.lit("_"), _slug(first))).otherwise(""))
    return F.when(person, who).otherwise(F.concat(F.lit("org:"), _slug(F.trim(name))))


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Distinct entities (doc_id, start, end, label) of all layers with the number of the first layer that has each and of how many have it: the union strategy, overlaps kept."""
    rows = None
    for k, layer in enumerate(layers):
        own = layer.select("doc_id", "start", "end", "label").distinct().withColumn("layer", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("doc_id", "start", "end", "label").agg(F.min("layer").alias("layer"), F.count(F.lit(1)).alias("votes"))


def chunked_extraction(docs: DataFrame, pattern: str, size: int, overlap: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, text) of a pattern's matches, found in chunks of `size` characters that overlap: offsets are moved back and what two chunks found stays once.

    A match at the cut end of a chunk is left to the next chunk. Exact for
    matches of under `overlap` characters that begin and end where the text
    around them says so, such as whole words.
    """
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    pieces = docs.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"), F.explode(starts).alias("__at")).select("doc_id", "__at", F.substring(F.col("__t"), F.col("__at") + 1, F.lit(size)).alias("__c"))
    found = pieces.select("doc_id", "__at", F.posexplode(F.regexp_extract_all("__c", F.lit(pattern), F.lit(0))).alias("k", "text"), F.split("__c", pattern).alias("__gaps"))
    before = F.aggregate(F.slice("__gaps", 1, F.col("k") + 1), F.lit(0), lambda n, g: n + F.length(g))
    own = found.withColumn("__gap", before).withColumn("__long", F.aggregate("__gaps", F.lit(0), lambda n, g: n + F.length(g)))
    earlier = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id", "__at").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.length("text")).over(Window.partitionBy("doc_id", "__at"))
    placed = own.select("doc_id", "__at", "text", (F.col("__gap") + earlier).alias("__s"), (F.col("__long") + total).alias("__size"))
    whole = ((F.col("__s") > 0) | (F.col("__at") == 0)) & ((F.col("__s") + F.length("text") < F.col("__size")) | (F.col("__size") < size))
    return placed.filter(whole).select("doc_id", (F.col("__at") + F.col("__s")).alias("start"), "text").distinct()


def knowledge_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, mentions) of distinct entities (doc_id, idx, label, text), by label and lower-case name, and edges (from_id, to_id, type, weight) of relations (doc_id, head_idx, tail_idx, relation); loops go."""
    key = lambda: F.concat(F.lower("label"), F.lit(":"), F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}]+", "_"))
    own = entities.withColumn("id", key())
    nodes = own.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("name"), F.count(F.lit(1)).alias("mentions"))
    end = lambda c, name: own.select("doc_id", F.col("idx").alias(c), F.col("id").alias(name))
    met = relations.join(end("head_idx", "from_id"), ["doc_id", "head_idx"]).join(end("tail_idx", "to_id"), ["doc_id", "tail_idx"]).filter("from_id <> to_id")
    return nodes, met.groupBy("from_id", "to_id", F.col("relation").alias("type")).agg(F.count(F.lit(1)).alias("weight"))


def events_by_trigger(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, pos, trigger, kind, negated) of words that a lexicon (trigger, kind) has; negated: a negation among the three words before."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.filter(F.split(F.lower(text), r"[^\p{L}']+"), lambda w: w != "").alias("__w"))
    at = words.select("doc_id", "__w", F.posexplode("__w").alias("pos", "trigger")).join(lexicon, "trigger")
    around = F.slice("__w", F.greatest(F.col("pos") - 2, F.lit(1)), F.least(F.col("pos"), F.lit(3)))
    return at.select("doc_id", "pos", "trigger", "kind", F.when(F.col("pos") == 0, False).otherwise(F.arrays_overlap(around, F.array(*map(F.lit, ("not", "no", "never", "without", "ne", "pas", "nicht", "kein"))))).alias("negated"))
