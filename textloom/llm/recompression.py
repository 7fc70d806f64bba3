"""Repeated passages across documents by recompression.

The words of all texts are compressed in rounds that are the same everywhere:
maximal runs of one symbol get a name, then every pair of a left and a right
symbol does (a bit of the name says which side a symbol is on, afresh in each
round). A name is a digest of what it stands for, so no dictionary is exchanged
and equal passages have equal symbols inside, whatever stands around them. With
each symbol goes its context, the words that fixed it: a symbol whose context
lies in a window is the same wherever the window's words stand.

A window's anchor is a symbol of the highest level whose context it contains,
the one of least name; equal windows have equal anchors. So a passage repeats
only where a high symbol with its context is shared, and only those places go
further:

* consecutive windows with one anchor make a block. Blocks of equal words are
  one class, and all of a class but those of its least document are repeats;
* where an anchor has several classes, the blocks of each one's least document
  are compared with one another window by window.

Both comparisons are of 128-bit digests of the words. A clash of names can only
add places to compare. Nothing is paired off: each step is a grouped minimum
joined back to its rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, stash

#: Words of a window; rounds of compression (symbols of about ten words, contexts of about thirty).
WINDOW, ROUNDS = 50, 8
#: Words that are compressed at a time; pieces overlap by a window less a word, which changes no anchor.
PIECE = 1 << 16
#: Bytes of a word beyond which its digest is not a polynomial.
LONG_WORD = 256
#: Bytes of texts that are laid out together: arrays of this size stay in a core's cache.
TOGETHER = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FAR = np.int32(1 << 29)
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Odd multipliers: of bytes and of words, one for each half of a digest.
_BYTES, _WORDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _raised(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of base and of its inverse, modulo 2 to the 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def _digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A digest of values[start:end] for each pair: sums of powers, of a stretch by its ends."""
    up, down = _raised(base, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=total[1:])
    return _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(_STEP))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about TOGETHER bytes each; a longer text makes one of its own."""
    step = max(1, int(batch.num_rows * TOGETHER / max(batch.nbytes, 1)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


class Words:
    """The words of a column of texts, laid out one after another with an empty place after each text.

    offset: place of each text's first word, and one beyond the last; count:
    words of each text; lanes: for every place the digest of its word, never 0,
    or 0 for an empty place, once for each multiplier asked for.
    """

    def __init__(self, texts: pa.Array, lanes: int = 1):
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        space, edge = _SPACE[data], np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        first, last = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
        owner = np.searchsorted(ends, first, side="right") - 1
        self.count = np.bincount(owner, minlength=len(texts))
        self.offset = np.concatenate([[0], np.cumsum(self.count + 1)])
        self._bytes = data, space, ends, last[:-1][owner[1:] == owner[:-1]]
        place = np.arange(len(first)) + owner
        long = np.flatnonzero(last - first > LONG_WORD)
        self.lanes = []
        for k in range(lanes):
            own = _digests(data.astype(_U) + _U(1), first, last, _BYTES[k])
            for w in long:
                own[w] = xxhash.xxh3_64_intdigest(data[first[w] : last[w]].tobytes(), seed=k)
            own[own == 0] = 1
            lane = np.zeros(self.offset[-1], _U)
            lane[place] = own
            self.lanes.append(lane)

    def sha256(self) -> list[str]:
        """For each text the digest of its words with one space between them."""
        data, space, ends, inner = self._bytes
        keep = ~space
        keep[inner] = True
        cuts = np.concatenate([[0], np.cumsum(keep)])[ends]
        written = memoryview(np.where(space, np.uint8(32), data)[keep].tobytes())
        return [hashlib.sha256(written[i:j]).hexdigest() for i, j in zip(cuts[:-1], cuts[1:])]


def _run_step(word: np.ndarray, name: np.ndarray, s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names maximal runs of a symbol. That a run ends is seen by the next word, unless that equals the word at the run's other end; then by the next symbol."""
    fresh = np.empty(len(name), bool)
    fresh[0] = True
    np.not_equal(name[1:], name[:-1], out=fresh[1:])
    fresh |= name == 0
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(name)) - 1
    many = np.flatnonzero(last > at)
    out = name[at]
    out[many] = _mixed(out[many] * _U(31) + (last - at + 1)[many].astype(_U))
    s2, e2 = s[at], e[last]
    lo2, hi2 = np.minimum(lo[at], s2 - 1), np.maximum(hi[last], e2 + 1)
    same = np.flatnonzero(word[np.maximum(s2 - 1, 0)] == word[e2 - 1])
    lo2[same] = np.minimum(lo2[same], lo[np.maximum(at[same] - 1, 0)])
    same = np.flatnonzero(word[np.minimum(e2, len(word) - 1)] == word[s2])
    hi2[same] = np.maximum(hi2[same], hi[np.minimum(last[same] + 1, len(name) - 1)])
    edge = np.flatnonzero(out == 0)
    lo2[0] = -_FAR
    hi2[-1] = _FAR
    lo2[edge[edge < len(out) - 1] + 1] = -_FAR
    hi2[edge[edge > 0] - 1] = _FAR
    lo2[edge], hi2[edge] = -_FAR, _FAR
    return out, s2, e2, lo2, hi2


def _pair_step(name: np.ndarray, s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Names each left symbol with the right symbol after it. One that stays alone is fixed by the neighbour that it might have gone with."""
    left = (_mixed(name + _U((level * _STEP) & 0xFFFFFFFFFFFFFFFF)) >> _U(63)).astype(bool)
    word = name != 0
    pair = np.zeros(len(name), bool)
    np.logical_and((left & word)[:-1], (~left & word)[1:], out=pair[:-1])
    keep = np.ones(len(name), bool)
    keep[1:] = ~pair[:-1]
    at = np.flatnonzero(keep)
    out, s2, e2, lo2, hi2 = name[at], s[at], e[at], lo[at], hi[at]
    p = pair[at]
    both = np.flatnonzero(p)
    nxt = at[both] + 1
    out[both] = _mixed(out[both] * _U(_STEP) + _mixed(name[nxt] ^ _U(0x243F6A8885A308D3)))
    e2[both] = e[nxt]
    lo2[both] = np.minimum(lo2[both], lo[nxt])
    hi2[both] = np.maximum(hi2[both], hi[nxt])
    alone = np.flatnonzero(~p & word[at])
    side = np.where(left[at[alone]], 1, -1)
    by = np.clip(at[alone] + side, 0, len(name) - 1)
    lo2[alone] = np.minimum(lo2[alone], lo[by])
    hi2[alone] = np.maximum(hi2[alone], hi[by])
    return out, s2, e2, lo2, hi2


def levels(word: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 0 the symbols of a stretch of places as (name, lo, hi): the context is [lo, hi); it is beyond all places where the stretch's or a text's end had a part in it."""
    s = np.arange(len(word), dtype=np.int32)
    edge = word == 0
    now = (word, s, s + np.int32(1), np.where(edge, -_FAR, s), np.where(edge, _FAR, s + np.int32(1)))
    found = [(now[0], now[3], now[4])]
    for level in range(1, rounds + 1):
        now = _pair_step(*_run_step(word, *now), level)
        found.append((now[0], now[3], now[4]))
    return found


def anchors(word: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of a lane as (place of its first word, name of its anchor, whether a block starts with it), by place."""
    starts, names, heads = [], [], []
    for begin in range(0, max(0, len(word) - window + 1), PIECE):
        piece = word[begin : begin + PIECE + window - 1]
        gaps = np.concatenate([[0], np.cumsum(piece == 0)])
        at = np.flatnonzero(gaps[window:] == gaps[: len(gaps) - window])
        if not len(at):
            continue
        name, mark = np.zeros(len(at), _U), np.zeros(len(at), np.int64)
        rest = np.arange(len(at))
        for level, (own, lo, hi) in reversed(list(enumerate(levels(piece, rounds)))):
            fits = np.flatnonzero(hi - lo <= window)
            if len(fits):
                own = own[fits] ^ _digests(piece, lo[fits], hi[fits], _WORDS[0])
                begun = np.cumsum(np.bincount(lo[fits] + 1, minlength=len(piece) + 1))[at[rest]]  # symbols whose context starts before the window
                ended = np.cumsum(np.bincount(hi[fits], minlength=len(piece) + 1))[at[rest] + window]  # whose context ends in it or before
                got = np.flatnonzero(ended > begun)
                best, begun, ended = begun[got], begun[got], ended[got]
                more = np.arange(len(got))
                while True:
                    begun[more] += 1
                    more = more[begun[more] < ended[more]]
                    if not len(more):
                        break
                    less = more[own[begun[more]] < own[best[more]]]
                    best[less] = begun[less]
                name[rest[got]] = own[best]
                mark[rest[got]] = level * len(piece) + fits[best]
                rest = np.delete(rest, got)
            if not len(rest):
                break
        head = np.empty(len(at), bool)
        head[0] = True
        head[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)
        starts.append(at + begin)
        names.append(name)
        heads.append(head)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    return np.concatenate(starts), np.concatenate(names), np.concatenate(heads)


def _lists(values: np.ndarray, at: np.ndarray, offset: np.ndarray) -> pa.Array:
    """Values, by place, as one list for each text."""
    cuts = np.searchsorted(at, offset).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))


def _named(window: int):
    """Arrow batches (doc_id, mark, text) to (doc_id, mark, digest, n_words, names): the anchors of each text, one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                words = Words(piece.column(2))
                at, name, head = anchors(words.lanes[0], window)
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(words.sha256(), pa.string()), pa.array(words.count), _lists(name[head].view(np.int64), at[head], words.offset)], ["doc_id", "mark", "digest", "n_words", "names"])

    return run


def _blocks(window: int):
    """Arrow batches (unit, first, digest, text, names) to a row for each block whose anchor is in names: (name, a, b, first, unit, start, stop), words from start to before stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                words = Words(piece.column("text"), 2)
                at, name, head = anchors(words.lanes[0], window)
                begin = np.flatnonzero(head)
                owner = np.searchsorted(words.offset, at[begin], side="right") - 1
                wanted = piece.column("names")
                sizes = np.diff(wanted.offsets.to_numpy())
                live = np.sort(_mixed(wanted.flatten().to_numpy().view(_U)) ^ _mixed(np.repeat(np.arange(len(sizes)), sizes).astype(_U) + _U(1)))
                key = _mixed(name[begin]) ^ _mixed(owner.astype(_U) + _U(1))
                found = np.searchsorted(live, key)
                hit = np.flatnonzero(np.append(live, _U(0))[found] == key) if len(live) else np.zeros(0, np.int64)
                last = np.append(begin[1:], len(at)) - 1
                start, stop, own = at[begin[hit]], at[last[hit]] + window, owner[hit]
                a, b = (_digests(lane, start, stop, m) for lane, m in zip(words.lanes, _WORDS))
                base = words.offset[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (name[begin[hit]].view(np.int64), a.view(np.int64), b.view(np.int64), piece.column("first").to_numpy()[own], piece.column("unit").to_numpy()[own], (start - base).astype(np.int32), (stop - base).astype(np.int32))],
                    ["name", "a", "b", "first", "unit", "start", "stop"],
                )

    return run


def _windows(window: int):
    """Arrow batches (first, unit, text, parts) to a row for each window in the parts of a text: (a, b, first, unit, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                words = Words(piece.column("text"), 2)
                parts = piece.column("parts")
                sizes = np.diff(parts.offsets.to_numpy())
                flat = parts.flatten()
                own = np.repeat(np.arange(len(sizes)), sizes)
                start, stop = flat.field("start").to_numpy().astype(np.int64), flat.field("stop").to_numpy().astype(np.int64)
                n = stop - start - window + 1
                own = np.repeat(own, n)
                start = np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                at = start + words.offset[own]
                a, b = (_digests(lane, at, at + window, m) for lane, m in zip(words.lanes, _WORDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a.view(np.int64), b.view(np.int64), piece.column("first").to_numpy()[own], piece.column("unit").to_numpy()[own], start.astype(np.int32))], ["a", "b", "first", "unit", "start"]
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (digest, text, parts) to (digest, spans, kept): parts joined where they touch, and the words outside them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    for batch in batches:
        digests, spans, kept = [], [], []
        for digest, text, parts in zip(*(batch.column(k) for k in range(3))):
            words = WORD.findall(text.as_py())
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, parts.values.field("start").to_numpy(), 1)
            np.add.at(depth, parts.values.field("stop").to_numpy(), -1)
            gone = np.cumsum(depth)[:-1] > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            digests.append(digest.as_py())
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turn[::2], turn[1::2])])
            kept.append(" ".join(words[k] for k in np.flatnonzero(~gone)))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(spans, kind), pa.array(kept, pa.string())], ["digest", "spans", "kept"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, digest, n_words, spans, kept), one per input row: what repeats a document of smaller id.

    spans: stretches (start, length) of words that are covered by windows of
    window words, each of which also starts in a document with a smaller id;
    null where nothing is. kept: the other words with one space between them;
    null where all words stay. digest: sha256 of the text's words with one space
    between them, in hex. Windows are those of the input, not of what is left.

    doc_id: an integer. A row without an id neither loses words nor takes any
    away; rows of one id do not repeat each other, whatever their texts. Null
    texts have no words, a text of fewer words than a window keeps them. Texts
    of equal words are compared once, for the least id. Extra columns are left
    out; an empty table gives no rows. A text's own parts are one task's, and
    texts go through the exchange once, with one row for each text that shares
    an anchor; the rest moves digests and numbers.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = whole.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    parsed = stash(keyed.mapInArrow(_named(window), "doc_id long, mark long, digest string, n_words long, names array<long>"), "anchors")
    able = parsed.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    units = able.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("own"), F.any_value(F.array_distinct("names")).alias("names"))
    units = stash(units.select("digest", F.col("own.doc_id").alias("first"), "own.mark", "names", F.monotonically_increasing_id().alias("unit")), "units")

    named = units.select("unit", "first", F.explode("names").alias("name"))
    shared = named.groupBy("name").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select("name")
    live = named.join(shared, "name").groupBy("unit").agg(F.collect_list("name").alias("names"))
    wanted = units.select("unit", "digest", F.col("first").alias("doc_id"), "mark").join(live, "unit")
    texts = stash(keyed.join(wanted, ["doc_id", "mark"]).select("unit", F.col("doc_id").alias("first"), "digest", "text", "names"), "shared")

    blocks = stash(texts.mapInArrow(_blocks(window), "name long, a long, b long, first long, unit long, start int, stop int"), "blocks")
    classes = stash(blocks.groupBy("name", "a", "b").agg(F.min("first").alias("low")), "classes")
    marked = stash(blocks.join(classes, ["name", "a", "b"]).select("name", "unit", "start", "stop", (F.col("first") > F.col("low")).alias("later")), "marked")
    same = marked.filter("later").select("unit", "start", "stop")
    several = classes.groupBy("name").agg(F.min("low").alias("low"), F.max("low").alias("high")).filter("low < high").select("name")
    open_parts = marked.filter("not later").join(several, "name").groupBy("unit").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    single = stash(texts.select("first", "unit", "text").join(open_parts, "unit").select("first", "unit", "text", "parts").mapInArrow(_windows(window), "a long, b long, first long, unit long, start int"), "windows")
    least = single.groupBy("a", "b").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select("a", "b", "low")
    alike = single.join(least, ["a", "b"]).filter("first > low").select("unit", "start", (F.col("start") + window).alias("stop"))

    gone = same.unionByName(alike).groupBy("unit").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    cut = stash(texts.select("unit", "digest", "text").join(gone, "unit").select("digest", "text", "parts").mapInArrow(_cut, "digest string, spans array<struct<start:int,length:int>>, kept string"), "cut")
    for made in (texts, blocks, classes, marked, single):
        drop_stash(made)
    firsts = units.select("digest", "first").join(cut.dropDuplicates(["digest"]), "digest", "left")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length")))
    copy = F.col("doc_id") > F.col("first")
    own = F.col("doc_id") == F.col("first")
    return parsed.select("doc_id", "digest", "n_words").join(firsts, "digest", "left").select(
        "doc_id", "digest", "n_words", F.when(copy, all_of_it).when(own, F.col("spans")).alias("spans"), F.when(copy, F.lit("")).when(own, F.col("kept")).alias("kept")
    )


def removed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) of ``repeats`` over documents: how many words go and the digest of those that stay."""
    found = repeats(docs)
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"]), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.coalesce(F.sha2("kept", 256), F.col("digest")).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL: every window as text, the least document of each, and the words that a later one covers."""
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT row_id, doc_id, i, sha256(array_to_string(words[i:i + {window - 1}], ' ')) AS passage
  FROM (SELECT row_id, doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM base WHERE len(words) >= {window})),
later AS (
  SELECT row_id, i FROM (SELECT row_id, doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS least FROM windows) WHERE least < doc_id),
gone AS (
  SELECT row_id, list_distinct(flatten(list(range(i, i + {window})))) AS places FROM later GROUP BY row_id)
SELECT b.doc_id, len(b.words)::BIGINT AS n_words, coalesce(len(g.places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g.places IS NULL THEN b.words ELSE list_filter(b.words, lambda w, k: NOT list_contains(g.places, k)) END, ' ')) AS kept_sha256
FROM base b LEFT JOIN gone g USING (row_id)"""
