"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent n-grams of one to
three letters; words are padded with a blank. A document's own ranked list is
compared to each profile: an n-gram adds the distance between its two ranks,
or the profile's length if it is missing there. The nearest profile wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import extended, keyed_text, slices, stash

#: n-grams of a profile.
PROFILE = 400
#: Characters of a text whose n-grams are counted at a time.
BLOCK_CHARS = 1 << 20
#: Distinct n-grams held by a training task before they are handed on.
HELD = 2_000_000
UNKNOWN = "und"
#: A text is recognised from FLOOR_SHARE of the score that all but LOWEST of its language's documents of like length reach.
LOWEST, FLOOR_SHARE = 0.01, 0.75
#: Steps to one of the scores that are counted, and documents below which a length, then a language, takes the floor of the next wider group.
SCORE_STEPS, LEAST_DOCS = 10_000, 30
_letters = re.compile(r"[^\W\d_]+")


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, each packed into one long (21 bits a character), and how often each occurs.

    The same whatever BLOCK_CHARS is: the last two signs of a block go before
    the next, and a word over the border stays one word.
    """
    parts, text, before = [], text or "", ""
    stream = np.empty(0, np.int64)  # the last two signs so far of all words, with a blank around each
    for i in range(0, len(text), BLOCK_CHARS):
        block = text[i : i + BLOCK_CHARS].replace("Σ", "σ").lower()  # whose lower case alone depends on what follows
        words = _letters.findall(block)
        goes_on = bool(_letters.match(before[-1:]) and _letters.match(block))
        before, last = block, i + BLOCK_CHARS >= len(text)
        if not words:
            if last and len(stream):
                words = [""]
            else:
                continue
        new = np.frombuffer((("" if goes_on or not words[0] else " ") + " ".join(words) + " " * last).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = np.concatenate([stream, new])
        two = c[:-1] << 21 | c[1:]
        three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
        parts.append(np.unique(np.concatenate([new[new != 32], two[max(0, len(stream) - 1) :], three]), return_counts=True))
        stream = c[-2:]
    return _merge(parts) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the packed number."""
    return grams[np.lexsort((grams, -counts))[:most]]


class Profiles:
    """Profiles of all languages in one table: a row for each n-gram of any, a column of ranks for each language."""

    def __init__(self, by_language: dict[str, list[int]], most: int = PROFILE) -> None:
        self.languages, self.most = sorted(by_language), most
        self.grams = np.unique(np.array([g for own in by_language.values() for g in own], np.int64))
        self.ranks = np.full((len(self.grams), len(self.languages)), -1, np.int32)
        for j, name in enumerate(self.languages):
            own = np.array(by_language[name], np.int64)
            self.ranks[np.searchsorted(self.grams, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - its distance as a share of the greatest possible; ties: the first name. No letter or no profile: und, 0."""
        return self.nearest(text)[:2]

    def nearest(self, text: str | None) -> tuple[str, float, int]:
        """predict() and the number of n-grams that were compared."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.languages or not any(map(str.isalpha, text)):  # number signs stand among the letters of a word
            return UNKNOWN, 0.0, 0
        own = ranked(grams, counts, self.most)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        far = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.languages[best], float(1 - far[best] / (len(own) * self.most)), len(own)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = PROFILE) -> Profiles:
    """Profiles from all documents that are not held out and have a lang and a text. At most `most` rows for each language come to the driver."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, counts = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for name, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    own = ngrams(t)
                    held[name].append(own)
                    size += len(own[0])
                if size > HELD:
                    held = defaultdict(list, {k: [_merge(v)] for k, v in held.items()})
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = defaultdict(list), 0
        yield from out()

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = defaultdict(list)
    for r in sorted(totals.withColumn("rank", rank).filter(F.col("rank") <= most).collect(), key=lambda r: r["rank"]):
        found[r.lang].append(r.gram)
    return Profiles(found, most)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", size_out: str | None = None) -> DataFrame:
    """docs with the predicted language and its score, and the number of n-grams compared if size_out is given; columns of those names are replaced. One pass, no shuffle."""
    names = {lang_out: "string", score_out: "double"} | ({size_out: "int"} if size_out else {})
    kept = docs.drop(*names)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = [profiles.nearest(t) for t in piece.column(at).to_pylist()]
                columns = [pa.array([x[k] for x in found], kind) for k, kind in zip(range(len(names)), (pa.string(), pa.float64(), pa.int32()), strict=False)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, *names])

    return kept.mapInArrow(run, extended(kept.schema, **names))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per input row.

    Profiles are learned from lang and text of the documents that are not held
    out; a prediction uses the text alone. A null text or one without a letter
    gives und and 0, as does every text if nothing could be learned. A null id
    is held out; repeated rows give repeated rows; an empty table no rows.
    """
    profiles = learn(docs, doc_id, text, lang, most)
    return predict(keyed_text(docs, doc_id, text), profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def score_floors(scored: DataFrame, lang: str, taught: Column, lang_out: str, score_out: str, length: Column) -> dict[tuple[str | None, int | None], float]:
    """The least score of (language, length), (language, None) and (None, None), each where at least LEAST_DOCS documents that taught a profile have it as theirs.

    It is FLOOR_SHARE of the exact lower quantile LOWEST of their scores, counted in steps.
    """
    own = scored.filter(taught & (F.col(lang).cast("string") == F.col(lang_out))).select(F.col(lang_out).alias("name"), length.alias("length"), F.floor(F.col(score_out) * SCORE_STEPS).alias("step"))
    groups = F.array(F.struct("name", "length"), F.struct("name", F.lit(None).cast("int").alias("length")), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("length")))
    counted = own.select(F.inline(groups), "step").groupBy("name", "length", "step").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("name", "length")
    upto = counted.withColumns({"upto": F.sum("n").over(by.orderBy("step")), "all": F.sum("n").over(by)})
    lows = upto.filter((F.col("all") >= LEAST_DOCS) & (F.col("upto") >= F.col("all") * LOWEST)).groupBy("name", "length").agg(F.min("step").alias("step"))
    return {(r.name, r.length): FLOOR_SHARE * r.step / SCORE_STEPS for r in lows.collect()}


def recognised(docs: DataFrame, least_score: float = 0.05, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with their columns, whose text is in a learned language: not und, a score of least_score, and one of the floor of its language and length.

    Floors come from all documents that taught the profiles (score_floors);
    lengths are classed by octaves of the n-grams compared. Too few documents
    of a length: the floor of the language, then that of all; too few at all:
    least_score alone. The texts are written once, scored, to the shared folder.
    Null, empty and letterless texts go; a null id or lang is judged by its text
    like any other; of repeated rows all stay or all go; an empty table gives no rows.
    """
    scored = stash(predict(docs, learn(docs, doc_id, text, lang), text, "__lang", "__score", "__size"), "scored")
    length = F.when(F.col("__size") >= PROFILE, F.lit(99)).otherwise(F.floor(F.log2(F.greatest(F.col("__size"), F.lit(1)).cast("double"))).cast("int"))
    taught = F.col(text).isNotNull() & ~held_out(F.col(doc_id))
    floors = score_floors(scored, lang, taught, "__lang", "__score", length)
    marked = scored.withColumn("__length", length)
    if floors:
        table = scored.sparkSession.createDataFrame([(*k, v) for k, v in sorted(floors.items(), key=str)], "name string, length int, floor double")
        own = F.broadcast(table.filter("length is not null").select(F.col("name").alias("__n1"), F.col("length").alias("__n2"), F.col("floor").alias("__f1")))
        any_length = F.broadcast(table.filter("name is not null and length is null").select(F.col("name").alias("__n3"), F.col("floor").alias("__f2")))
        marked = marked.join(own, (F.col("__lang") == F.col("__n1")) & (F.col("__length") == F.col("__n2")), "left").join(any_length, F.col("__lang") == F.col("__n3"), "left")
        floor = F.coalesce("__f1", "__f2", F.lit(floors.get((None, None), 0.0)))
    else:
        floor = F.lit(0.0)
    return marked.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= F.greatest(floor, F.lit(least_score)))).select(*docs.columns)
