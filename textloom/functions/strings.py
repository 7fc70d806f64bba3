"""String distance, similarity and text forms as Column expressions; pandas UDFs only where a value depends on a table of distances."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words. Fixed value.
SPACE = r"[\s\u0085   -     　]+"


def words(text: Column) -> Column:
    """The white-space separated words."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct elements of two arrays; both empty: 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def normalized_distance(a: Column, b: Column) -> Column:
    """2 d / (|a| + |b| + d) for edit distance d; both empty: 0."""
    d = F.levenshtein(a, b)
    return F.when(F.length(a) + F.length(b) == 0, 0.0).otherwise(2.0 * d / (F.length(a) + F.length(b) + d))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the normalised distance."""
    return 1 - normalized_distance(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - d / length of the longer; equal or both empty: 1."""
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def string_similarity(a: Column, b: Column) -> Column:
    """Both empty 1, one empty 0, equal without case 1, one within the other 0.8, else shared words."""
    la, lb = F.lower(a), F.lower(b)
    return (
        F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(la == lb, 1.0).when(la.contains(lb) | lb.contains(la), 0.8).otherwise(jaccard(words(la), words(lb)))
    )


def track_similarity(a: Column, b: Column) -> Column:
    """Shared lower-case words without a possessive ending."""
    bare = lambda c: F.transform(words(F.lower(c)), lambda w: F.regexp_replace(w, r"['’]s$", ""))
    return jaccard(bare(a), bare(b))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is its own run."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, runs).otherwise(F.array(text)))


def collapse(text: Column) -> Column:
    """Lower case, one blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def multilingual_similarity(a: Column, b: Column) -> Column:
    """Equal 1; else shared words where both scripts part words by blanks, else shared pairs of characters."""
    unspaced = r"[぀-ヿ㐀-䶿一-鿿฀-๿]"
    x, y = collapse(a), collapse(b)
    chars = F.coalesce(x.rlike(unspaced), F.lit(False)) | F.coalesce(y.rlike(unspaced), F.lit(False))
    return F.when(x == y, 1.0).when(chars, jaccard(char_ngrams(x, 2), char_ngrams(y, 2))).otherwise(jaccard(words(x), words(y)))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def _winkler(a: str, b: str, weight: float = 0.1) -> float:
    j = _jaro(a, b)
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + same * weight * (1 - j)


def _osa(a: str, b: str) -> int:
    """Restricted edit distance with neighbouring transpositions."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (x != y))
            row.append(best)
        before, last = last, row
    return last[-1]


def _weighted(a: str, b: str, insert: float, delete: float, substitute: float) -> float:
    last = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * delete]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + delete, row[j - 1] + insert, last[j - 1] + (0 if x == y else substitute)))
        last = row
    return last[-1]


def _wild(pattern: str, text: str) -> int:
    """Edit distance in which ? stands for any character and * for any run, at no cost."""
    last = list(range(len(text) + 1))
    for x in pattern:
        if x == "*":
            row, low = [], len(text) + len(pattern)
            for v in last:
                low = min(low, v)
                row.append(low)
        else:
            row = [last[0] + 1]
            for j, y in enumerate(text, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x not in ("?", y))))
        last = row
    return last[-1]


def _pairwise(function, kind: str):
    """A pandas UDF of a function of two strings; a null gives a null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; transpositions are halved downwards."""
    return _pairwise(_jaro, "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro raised by a tenth of the rest for each of up to four shared first characters, at any level."""
    return _pairwise(_winkler, "double")(a, b)


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance with neighbouring transpositions, none edited further."""
    return _pairwise(_osa, "int")(a, b)


def weighted_distance(a: Column, b: Column, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> Column:
    """Edit distance with a cost of its own for each kind of edit."""
    return _pairwise(lambda x, y: float(_weighted(x, y, insert, delete, substitute)), "double")(a, b)


def wildcard_distance(pattern: Column, text: Column) -> Column:
    """Edit distance of a pattern with ? and *."""
    return _pairwise(_wild, "int")(pattern, text)


@F.pandas_udf(T.StringType())
def _bare(text: pd.Series) -> pd.Series:
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.category(c).startswith("M"))
    return text.map(lambda t: None if t is None else fold(t))


def fold_marks(text: Column) -> Column:
    """Lower case without diacritics."""
    return _bare(text)


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).lower().split()))


def unicode_normalize(text: Column) -> Column:
    """Composed, lower case, white space collapsed; diacritics stay."""
    return _composed(text)


def canonical_entity(text: Column, tag: Column, aliases: dict[str, str] | None = None) -> Column:
    """ent:TAG:form: lower case without marks and ASCII punctuation, white space collapsed, then aliased."""
    form = F.trim(F.regexp_replace(F.regexp_replace(fold_marks(text), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))
    if aliases:
        table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        form = F.coalesce(table[form], form)
    return F.concat(F.lit("ent:"), tag, F.lit(":"), form)


def pii_token_ref(label: Column, token: Column) -> Column:
    """pii:LABEL:TOKEN."""
    return F.concat(F.lit("pii:"), label, F.lit(":"), token)


def fts_terms(text: Column, most: int = 8) -> Column:
    """The first terms of a keyword query: runs of letters, digits, apostrophes and hyphens, those two trimmed."""
    parts = F.transform(F.split(text, r"[^\p{L}\p{N}'-]+"), lambda w: F.regexp_replace(w, r"^['-]+|['-]+$", ""))
    return F.slice(F.filter(parts, lambda w: w != ""), 1, most)


def fts_query(text: Column, most: int = 8) -> Column:
    """The terms in quotes, joined by AND; none: null."""
    terms = fts_terms(text, most)
    return F.when(F.size(terms) > 0, F.concat_ws(" AND ", F.transform(terms, lambda w: F.concat(F.lit('"'), w, F.lit('"')))))


def byte_to_char(text: Column, offset: Column) -> Column:
    """Characters before a byte offset that is at the border of one."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8"))


def char_to_byte(text: Column, offset: Column) -> Column:
    """Bytes before a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), offset))


#: English pronouns. Fixed values.
PRONOUNS = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves themself "
    "this these those who whom whose which that what one ones someone anyone everyone somebody anybody everybody nobody something anything everything nothing "
    "xe xem xyr xyrs xemself ze hir zir hirs zirs hirself zirself ey em eir eirs emself fae faer faers faeself faerself"
).split() + ["no one"]
#: Words that make a mention nominal. Fixed values.
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those", "some", "any")


def mention_type(text: Column) -> Column:
    """pronominal, nominal (begins with a determiner), proper (begins with a capital), else nominal."""
    low, first = F.lower(text), F.substring(F.ltrim(text), 1, 1)
    return (
        F.when(F.trim(low).isin(PRONOUNS), "pronominal")
        .when(low.rlike("^(" + "|".join(DETERMINERS) + ") "), "nominal")
        .when((first != F.lower(first)) & (first == F.upper(first)), "proper")
        .otherwise("nominal")
    )


def context_window(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text from `around` characters before a span to as many after it, as far as there are any."""
    low = F.greatest(start - around, F.lit(0))
    return F.substring(text, low + 1, F.least(end + around, F.length(text)) - low)


def uri_safe(text: Column) -> Column:
    """Letters, digits, - . _ ~ stay; anything else becomes an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9\-._~]", "_")
