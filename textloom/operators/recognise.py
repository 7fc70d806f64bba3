"""Names by the shape of their words and by what stands around them: no model. Words that may be part of a name
are cut out of texts batch by batch, each with its neighbours; only they are shuffled and windowed.

Words with a capital make runs, joined by `of` and `the` before another; a run
ends at closing brackets and sentence ends unless a company's suffix follows.
Words that open sentences are taken off a run's front, words of a trade never are
in one. A title before a run goes with it. What a run is follows from the first
rule that fits it; the rules' weights are a table, and so are the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closed classes of words, by kind; further kinds (known_org, known_loc, known_per, acronym) and words are the caller's. Fixed values.
WORDS = {
    "suffix": "inc corp ltd llc co plc foundation institute university college bank group agency gmbh ag kg sa spa nv bv pty ab limited corporation incorporated company holding holdings services technologies systems partners solutions industries enterprises laboratories labs association council commission committee authority bureau department ministry".split(),
    "title": "mr ms mrs dr prof".split(),
    "before_place": "in from at to near aus nach bei von en de à dans por sur".split(),
    "place_word": "united new south north west east great".split(),
    "opener": "the a an this that these those it he she we they in on at to for from by with and but or so yet if because please see note today yesterday tomorrow now then".split(),
    "trade": "ceo cto cfo coo vp president chairman director manager secretary treasurer".split(),
}
#: Rule, label and weight, the first that fits. Fixed values.
RULES = (
    ("quarter", None, 0.0), ("title_alone", None, 0.0), ("org_suffix", "ORG", 0.85), ("known_org", "ORG", 0.80), ("known_loc", "LOC", 0.80), ("known_per", "PER", 0.75), ("title_and_name", "PER", 0.75), ("acronym_in_run", "ORG", 0.70),
    ("after_place_word", "LOC", 0.70), ("place_of_two", "LOC", 0.65), ("two_words", "PER", 0.60), ("of_in_second", "ORG", 0.65), ("long_run", "ORG", 0.50), ("letter", None, 0.0), ("known_acronym", None, 0.0), ("acronym", "ORG", 0.55), ("opens_sentence", "PER", 0.30), ("capital", "PER", 0.45),
)
#: The weight from which a run is a name. Fixed value.
LEAST = 0.35
_BLANK = re.compile(r"[ \t\n\x0B\f\r]")


def _shaped(word: str) -> bool:
    """Whether a word may have a capital as its first letter or digit: any that has one by Java's classes may."""
    return not "a" <= word[0] <= "z" and (word != word.lower() or not word.isascii())


def _around(text: str) -> tuple[list, ...]:
    """Columns pos, start, word, next, before, before_start, before2 of the words that may be part of a name; pos counts words, start is in characters."""
    cut = _BLANK.split(text)
    start = [None, None, *(at for at, w in zip(accumulate((len(w) + 1 for w in cut), initial=0), cut) if w)]
    word = [None, None, *(w for w in cut if w), None]
    shaped = [False, False, *map(_shaped, word[2:-1]), False]
    at = [k for k in range(2, len(word) - 1) if shaped[k] or (shaped[k + 1] and word[k] in ("of", "the"))]
    return [k - 2 for k in at], [start[k] for k in at], [word[k] for k in at], [word[k + 1] for k in at], [word[k - 1] for k in at], [start[k - 1] for k in at], [word[k - 2] for k in at]


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, pos, start, word, next, before, before_start, before2) of the words between white space that do not start with a small letter of ASCII and have a capital or a letter beyond ASCII, or are `of` or `the` before one: their number and place in the text and the words around them. row: a number for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")).filter("text is not null")
    names = ["pos", "start", "word", "next", "before", "before_start", "before2"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, columns = [], [[] for _ in kinds]
            for k, t in enumerate(batch.column(2)):
                found = _around(t.as_py())
                owner += [k] * len(found[0])
                for column, own in zip(columns, found):
                    column += own
            keys = batch.select([0, 1]).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=["doc_id", "row", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, pos int, start int, word string, next string, before string, before_start int, before2 string")


#: A word whose first letter or digit is a capital.
CAPITAL = r"^[^\p{L}\p{N}]*\p{Lu}"


def _clean(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _capitals(word: Column) -> Column:
    """Two letters or more, all of them capitals."""
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (F.upper(letters) == letters)


def names(docs: DataFrame, lexicon: dict[str, list[str]] | None = None, rules: DataFrame | None = None, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, text, label, confidence, reason) of the names in texts, ends exclusive.

    lexicon: words by kind, added to WORDS (lower case; bounded, as it is part of
    the plan); rules: reason, label, weight in the place of RULES. Null and empty
    texts have none; repeated rows have theirs each; a null id is kept.
    """
    known = {k: [*WORDS.get(k, []), *(lexicon or {}).get(k, [])] for k in {*WORDS, *(lexicon or {}), "known_org", "known_loc", "known_per", "acronym"}}
    is_a = lambda kind, c: c.isin(*known[kind]) if known[kind] else F.lit(False)
    order = Window.partitionBy("row").orderBy("pos")
    rows = words(docs, doc_id, text).withColumn("plain", _clean(F.col("word"))).withColumn("low", F.lower("plain")).withColumn("cap", F.col("word").rlike(CAPITAL))
    rows = rows.withColumn("next_low", F.lower(_clean(F.col("next")))).withColumn("next_cap", F.col("next").rlike(CAPITAL))
    ends = F.col("word").rlike(r"[)\]}.!?]$") & ~F.coalesce(is_a("suffix", F.col("next_low")), F.lit(False))
    joins = F.lower("word").isin("of", "the") & F.coalesce(F.col("next_cap"), F.lit(False)) & ~ends
    rows = rows.withColumn("ends", ends).withColumn("in", (F.col("cap") & ~is_a("trade", F.col("low"))) | joins)
    rows = rows.filter("in")
    fresh = F.coalesce(F.lag("pos").over(order) != F.col("pos") - 1, F.lit(True)) | F.coalesce(F.lag("ends").over(order), F.lit(False))
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(order))
    opens = F.min(F.when(F.col("cap") & ~is_a("opener", F.col("low")), F.col("pos"))).over(Window.partitionBy("row", "run"))
    inside = rows.withColumn("first", opens).filter("pos >= first")
    items = inside.groupBy("doc_id", "row", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "word", "plain", "low", "before", "before_start", "before2"))).alias("w"))
    head, tail = F.get("w", F.lit(0)), F.element_at("w", -1)
    titled = F.coalesce(is_a("title", F.lower(F.regexp_replace(head["before"], r"\.+$", ""))), F.lit(False))
    lead = F.length(F.regexp_extract(head["word"], r"^[^\p{L}\p{N}]+", 0))
    trail = F.length(F.regexp_extract(tail["word"], r"[^\p{L}\p{N}]+$", 0))
    items = items.withColumn("titled", titled).withColumn("start", F.when(titled, head["before_start"]).otherwise(head["start"] + lead)).withColumn("end", tail["start"] + F.length(tail["word"]) - F.when(titled, 0).otherwise(trail))
    items = items.withColumn("n", F.size("w") + F.col("titled").cast("int")).withColumn("one", head["low"]).withColumn("two", F.when(F.col("titled"), head["low"]).otherwise(F.get("w", F.lit(1))["low"])).withColumn("last", tail["low"])
    items = items.withColumn("joined", F.array_join(F.transform("w", lambda x: x["low"]), " ")).withColumn("prior", F.when(F.col("titled"), head["before2"]).otherwise(head["before"]))
    shouted = F.exists("w", lambda x: _capitals(x["plain"]) & ~is_a("trade", x["low"]) & ~is_a("acronym", x["low"]))
    n, one = F.col("n"), F.col("one")
    place = F.coalesce(is_a("before_place", F.lower("prior")), F.lit(False))
    begins = F.col("prior").isNull() | F.col("prior").rlike(r"[.!?]$")
    known_as = lambda kind: ~F.col("titled") & is_a(kind, one) | is_a(kind, F.col("joined"))
    reason = (
        F.when(F.col("joined").rlike(r"^q[1-4]( (fy.*|[0-9]+|h1|h2))*$") & ~F.col("titled"), "quarter").when((n == 1) & is_a("title", one), "title_alone").when(is_a("suffix", F.col("last")), "org_suffix")
        .when(known_as("known_org"), "known_org").when(known_as("known_loc"), "known_loc").when(known_as("known_per"), "known_per").when(F.col("titled"), "title_and_name").when((n >= 2) & shouted, "acronym_in_run").when(place, "after_place_word")
        .when((n == 2) & is_a("place_word", one), "place_of_two").when(n == 2, "two_words").when((n > 2) & (F.col("two") == "of"), "of_in_second").when(n > 2, "long_run").when(F.length(one) == 1, "letter")
        .when(_capitals(F.get("w", F.lit(0))["plain"]) & is_a("acronym", one), "known_acronym").when(_capitals(F.get("w", F.lit(0))["plain"]), "acronym").when(begins, "opens_sentence").otherwise("capital")
    )
    weights = rules if rules is not None else docs.sparkSession.createDataFrame(list(RULES), "reason string, label string, weight double")
    said = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    trimmed = F.when(F.col("titled"), F.concat(head["before"], F.lit(" "), said)).otherwise(_clean(said))
    return items.select("doc_id", "start", "end", trimmed.alias("text"), reason.alias("reason")).join(F.broadcast(weights), "reason").filter(F.col("weight") >= least).select("doc_id", "start", "end", "text", "label", F.col("weight").alias("confidence"), "reason")
