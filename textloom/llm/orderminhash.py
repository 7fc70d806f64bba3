"""Document fingerprints by Order MinHash.

k-mers of characters are numbered by occurrence, so a repeated one counts as
often as it stands. For each of SKETCHES hash functions the TUPLE least
(k-mer, number) pairs are chosen, put back into text order and hashed as a
tuple. The share of equal tuples of two texts falls with their edit distance,
and texts of the same k-mers in another order differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keyed_text, slices, stash

#: Characters of a k-mer (a power of two), pairs of a tuple, tuples of a fingerprint.
KMER, TUPLE, SKETCHES = 8, 2, 64
#: k-mers that are hashed at a time.
BLOCK = 1 << 11

_rng = np.random.default_rng(20180913)  # any fixed seed: fingerprints are comparable if it stays
_ODD = (_rng.integers(0, 1 << 31, SKETCHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ROWS = np.arange(SKETCHES)
_room = np.empty((SKETCHES, BLOCK), np.uint32)
#: Numbers of a fingerprint, in one byte order everywhere.
_U16 = np.dtype("<u2")
_STEP_INT = 0x9E3779B97F4A7C15
_STEP = np.uint64(_STEP_INT)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order; runs of 1, 2, 4, ... characters are joined two by two. A shorter text is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(points) < KMER:
        points = np.concatenate([np.zeros(KMER - len(points), np.uint64), points])
    size = 1
    while size < KMER:
        points = points[:-size] * np.uint64(pow(_STEP_INT, size, 1 << 64)) + points[size:]
        size *= 2
    return _mixed(points)


def _numbered(grams: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers together with the number of the occurrence; a first occurrence keeps its hash."""
    ordered = np.sort((grams >> np.uint64(32)).astype(np.uint32))
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return grams
    marked = np.zeros(1 << 16, bool)
    marked[twice >> np.uint32(16)] = True
    at = np.flatnonzero(marked[(grams >> np.uint64(48)).astype(np.uint16)])  # all that may stand twice, and some others
    own = grams[at]
    by = np.argsort(own, kind="stable")
    own = own[by]
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    starts = np.flatnonzero(fresh)
    number = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    out = grams.copy()
    later = number > 0
    out[at[by[later]]] = _mixed(own[later] + number[later].astype(np.uint64) * _STEP)
    return out


def sketch(text: str | None) -> np.ndarray:
    """The fingerprint as SKETCHES numbers of 16 bits. Fewer characters than a k-mer: the whole text is the one k-mer; no character: zeros."""
    if not text:
        return np.zeros(SKETCHES, _U16)
    grams = _grams(text)
    low = (_numbered(grams) >> np.uint64(32)).astype(np.uint32)
    values, places = [], []
    for at in range(0, len(low), BLOCK):
        part = low[at : at + BLOCK]
        order = np.multiply(_ODD[:, None], part[None, :], out=_room[:, : len(part)])
        for _ in range(min(TUPLE, order.shape[1])):
            k = order.argmin(axis=1)
            values.append(order[_ROWS, k])
            places.append(k + at)
            order[_ROWS, k] = 0xFFFFFFFF
    chosen = np.array(places)
    if len(chosen) > TUPLE:  # the least over all blocks; ties: the first place
        least = np.argsort(np.array(values), axis=0, kind="stable")[:TUPLE]
        chosen = np.take_along_axis(chosen, least, axis=0)
    chosen.sort(axis=0)
    out = np.full(SKETCHES, 0x243F6A8885A308D3, np.uint64)
    for own in chosen:
        out = _mixed(out * _STEP + grams[own])
    return (out >> np.uint64(48)).astype(_U16)


def written(fingerprint: np.ndarray) -> str:
    """Four hex digits for each number."""
    return fingerprint.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint), one per input row, repeats and null ids included; null texts count as empty, extra columns are left out, an empty table gives no rows. One pass, no shuffle."""
    keyed = keyed_text(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([written(sketch(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return keyed.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many characters, or all, from the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_MARKS = "n_chars long, edited_sha256 binary, mark binary, edited_mark binary, near_edited double, near_next double"


def _probe(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    mark = own if changed == text else sketch(changed)
    return len(text), hashlib.sha256(changed.encode()).digest(), own.tobytes(), mark.tobytes(), likeness(own, mark), likeness(own, theirs)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def edit_probe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one per input row: each text against its edit with the next one, in descending order of id; the last row is followed by the first.

    Rows of one id follow each other by text; null ids come last, and a null
    text counts as empty. A lone row is followed by itself. An id that is not
    a number is an error; extra columns are left out; an empty table gives no
    rows.

    The texts are dealt out by ranges of ids once and pass in order, two at a
    time. A range's last row meets the first row of the next range in a small
    join afterwards: two texts for each range.
    """
    keyed = keyed_text(docs, doc_id, text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last_first = F.col("doc_id").desc_nulls_last()
    dealt = keyed.repartitionByRange(ranges, last_first).sortWithinPartitions(last_first, "text")
    marks = {"n_chars": pa.int64(), "edited_sha256": pa.binary(), "mark": pa.binary(), "edited_mark": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
    first_pass = {"kind": pa.int32(), "range": pa.int32(), "doc_id": pa.int64(), "text": pa.string()} | marks

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, before, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for piece in slices(batch):
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    now = (i, t, sketch(t))
                    if before is None:
                        out.append((1, here, i, t, len(t), None, now[2].tobytes(), None, None, None))
                    else:
                        out.append((0, here, before[0], None, *_probe(before[1], before[2], t, now[2])))
                    before = now
                if out:
                    yield _batch(out, first_pass)
                    out = []
        if before is not None:
            yield _batch([(2, here, before[0], before[1], len(before[1]), None, before[2].tobytes(), None, None, None)], first_pass)

    passed = stash(dealt.mapInArrow(walk, f"kind int, range int, doc_id long, text string, {_MARKS}"), "edit-probe")
    heads, tails = (passed.filter(F.col("kind") == k) for k in (1, 2))
    filled = sorted(r.range for r in heads.select("range").collect())  # numbers of ranges, not rows
    follows = spark.createDataFrame([(a, filled[(k + 1) % len(filled)]) for k, a in enumerate(filled)], "range int, next int")
    edges = tails.select("range", "doc_id", "text", "mark").join(follows, "range").join(heads.select(F.col("range").alias("next"), F.col("text").alias("next_text"), F.col("mark").alias("next_mark")), "next").select("doc_id", "text", "mark", "next_text", "next_mark")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *_probe(t, np.frombuffer(a, _U16), u, np.frombuffer(b, _U16))) for i, t, a, u, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows, {"doc_id": pa.int64()} | marks)

    result = passed.filter(F.col("kind") == 0).select("doc_id", *marks).unionByName(edges.mapInArrow(close, f"doc_id long, {_MARKS}"))
    return result.select("doc_id", "n_chars", _hex("edited_sha256").alias("edited_sha256"), _hex("mark").alias("fingerprint"), _hex("edited_mark").alias("edited_fingerprint"), "near_edited", "near_next")


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))
