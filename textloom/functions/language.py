"""Script and language of a text by counting characters, all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.validators import let

#: Character classes, votes of each character, language; the order settles ties. Fixed values.
VOTES = (
    ("english", "[a-zA-Z]", 1),
    ("german", "[ßäöüÄÖÜ]", 10),
    ("french", "[àâçéèêëîïôûù]", 5),
    ("spanish", "[ñ¿¡áíóú]", 5),
    ("russian", "[Ѐ-ӿ]", 1),
    ("chinese", "[一-鿿]", 1),
    ("japanese", "[぀-ヿ]", 1),
    ("korean", "[가-힯]", 1),
    ("arabic", "[؀-ۿ]", 1),
    ("hebrew", "[֐-׿]", 1),
)
#: Scripts in order of precedence: of equal counts the last counts. Fixed values.
SCRIPTS = (
    ("latin", "\u0000-ɏ"),
    ("cjk", "一-鿿㐀-䶿"),
    ("kana", "぀-ゟ゠-ヿ"),
    ("hangul", "가-힯ᄀ-ᇿ"),
    ("arabic", "؀-ۿݐ-ݿ"),
    ("cyrillic", "Ѐ-ԯ"),
    ("devanagari", "ऀ-ॿ"),
    ("greek", "Ͱ-Ͽἀ-῿"),
    ("hebrew", "֐-׿"),
    ("thai", "฀-๿"),
)
#: What counts for no script: white space and ASCII punctuation. Fixed value.
IGNORED = r"[\s\u0085   -     　!-/:-@\[-`{-~]"


def detect_language(text: Column) -> Column:
    """The language with most votes; ties: the first of VOTES; none: english. Kana makes Chinese Japanese.

    A text of ASCII alone has votes for none but english. Of any other its
    letters are counted as what is left without the rest, and all other
    classes on its characters beyond ASCII.
    """
    names = F.array(*(F.lit(n) for n, _, _ in VOTES))
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]+", ""))
    wide = {n: (p, k) for n, p, k in VOTES if n != "english"}
    kana = list(wide).index("japanese")

    def winner(counted: Column) -> Column:
        best = F.element_at(names, F.array_position(counted, F.array_max(counted)).cast("int"))
        return F.when((best == "chinese") & (F.get(counted, F.lit(kana + 1)) > 0), "japanese").otherwise(best)

    counts = let(F.regexp_replace(text, r"[\x00-\x7F]+", ""), lambda rest: F.array(letters, *(F.regexp_count(rest, F.lit(p)) * k for p, k in wide.values())))
    return F.when(F.length(text) == F.octet_length(text), "english").otherwise(let(counts, winner))


def detect_script(text: Column) -> Column:
    """The script of most characters; mixed if two have at least a fifth each (and one character), or there are none.

    What is counted for the other scripts is what Latin letters leave of the text, and each step is worked out once.
    """
    others = SCRIPTS[1:]
    names = F.array(*(F.lit(n) for n, _ in SCRIPTS), F.lit("mixed"))

    def winner(every: Column) -> Column:
        total = F.aggregate(every, F.lit(0), lambda s, c: s + c)
        least = F.greatest(F.floor(total * 0.2), F.lit(1))
        last = F.size(every) - F.array_position(F.reverse(every), F.array_max(every)).cast("int") + 1
        return let(least, lambda n: F.when((total == 0) | (F.size(F.filter(every, lambda c: c >= n)) >= 2), "mixed").otherwise(F.element_at(names, last)))

    def counted(latin: Column, rest: Column) -> Column:
        return let(F.array(*(F.regexp_count(rest, F.lit(f"[{p}]")) for _, p in others)), lambda known: F.concat(F.array(latin), known, F.array(F.length(rest) - F.aggregate(known, F.lit(0), lambda s, c: s + c))))

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"{IGNORED}+", "")
    parts = let(bare, lambda b: F.struct(F.length(b).alias("n"), F.regexp_replace(b, f"[{SCRIPTS[0][1]}]+", "").alias("rest")))
    return let(let(parts, lambda x: counted(x["n"] - F.length(x["rest"]), x["rest"])), winner)


def code_switches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10) -> DataFrame:
    """Rows (doc_id, start, end, language): stretches between changes of the language of overlapping windows of characters.

    Windows start every half a window; the stretch before the first change is
    in the language of the whole text. Two windows of ten characters a row
    are exploded and never gathered: changes are found by lag.
    """
    step = window // 2
    t = F.col(text)
    rows = docs.filter(F.length(t) > 0).select(
        F.col(doc_id).alias("doc_id"), F.length(t).alias("n"), detect_language(t).alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(step)), lambda i: F.struct(i.alias("i"), F.substring(t, i + 1, F.lit(window)).alias("w")))).alias("x")
    )
    rows = rows.select("doc_id", "n", "whole", "x.i", detect_language(F.col("x.w")).alias("language"))
    order = Window.partitionBy("doc_id").orderBy("i")
    changed = rows.withColumn("before", F.coalesce(F.lag("language").over(order), F.col("whole"))).filter("language <> before")
    first = docs.filter(F.length(t) > 0).select(F.col(doc_id).alias("doc_id"), F.length(t).alias("n"), F.lit(0).alias("i"), detect_language(t).alias("language"), F.lit(0).alias("k"))
    marks = first.unionByName(changed.select("doc_id", "n", "i", "language", F.lit(1).alias("k")))
    ends = Window.partitionBy("doc_id").orderBy("i", "k")
    return marks.withColumn("end", F.coalesce(F.lead("i").over(ends), F.col("n"))).filter("i < end").select("doc_id", F.col("i").alias("start"), "end", "language")
