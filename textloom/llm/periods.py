"""Periodic runs of words by a scan of all lags.

A text's words become numbers. For every lag q up to a quarter of the words
(a run has an exponent of at least EXPONENT) the numbers are compared with
themselves q places on; a stretch of m equal places is a stretch of m + q words
with period q. The scan of a text is a range of lags; a long text's lags are cut
into ranges of about equal work, which Spark deals to tasks of their own.

A stretch with period q whose least period is p has the same ends as the run of
period p: both periods together are no longer than the stretch, so p divides q
and neither can be extended further than the other. Of stretches with equal
ends the least lag is the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SLICE_BYTES, bounded_batches, drop_stash, stash
from textloom.llm.digests import crc32_sql

#: Least words of a run, and least number of periods in it.
LEAST, EXPONENT = 6, 4
#: Characters of a text up to which all its lags are one range: at most a quarter of a thousand million comparisons.
NARROW = 1 << 16
#: Comparisons of one range of lags of a longer text, about.
RANGE = 1 << 29
#: Comparisons that are held in memory at a time.
BLOCK = 1 << 19

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:long,length:long,period:long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[str]) -> np.ndarray:
    """Each word's number: that of its first occurrence among the different words."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows (start, length, lag) for each maximal stretch of equal places of the lags from first to last that is long enough for a run."""
    n, found = len(ids), []
    lag = first
    while lag <= last:
        many = min(last - lag + 1, max(1, BLOCK // n))
        wide = n - lag
        ahead = np.full(n + many, -1, np.int32)
        ahead[:n] = ids
        shifted = np.lib.stride_tricks.as_strided(ahead[lag:], (many, wide), (4, 4))  # row k: the words lag + k places on, then -1
        equal = np.empty((many, wide + 2), bool)
        equal[:, 0] = equal[:, -1] = False
        np.equal(shifted, ids[:wide], out=equal[:, 1:-1])
        lags = np.arange(lag, lag + many)
        need = np.maximum(LEAST, EXPONENT * lags) - lags
        four = equal[:, :-1] & equal[:, 1:]
        may = np.flatnonzero((four[:, :-2] & four[:, 2:]).any(axis=1)) if wide > 2 else np.arange(0)  # a run has more than four equal places in a row
        if len(may):
            row, turn = np.nonzero(equal[may, 1:] != equal[may, :-1])
            row, begin, length = may[row[::2]], turn[::2], turn[1::2] - turn[::2]
            long = length >= need[row]
            found.append(np.stack([begin[long], (length + lags[row])[long], lags[row][long]], axis=1))
        lag += many
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_lags(found: np.ndarray) -> np.ndarray:
    """The runs among stretches: of equal start and length the least lag; by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]


def runs(words: list[str]) -> np.ndarray:
    """All runs of a text as rows (start, length, period), by start, then period."""
    return least_lags(stretches(numbered(words), 1, len(words) // EXPONENT)) if len(words) >= LEAST else np.zeros((0, 3), np.int64)


def collapsed(words: list[str], found: np.ndarray) -> str:
    """The words but those that a run contains after its first period, with one space between them."""
    if not len(found):
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    """One list of runs for each array of rows."""
    cuts = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
    flat = np.concatenate([np.zeros((0, 3), np.int64), *rows])
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])).cast(_KIND)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text whose lags are one range, becomes its runs and collapsed text."""
    for batch in batches:
        for piece in _pieces(batch):
            texts = [WORD.findall(t or "") for t in piece.column(piece.num_columns - 1).to_pylist()]
            found = [runs(words) for words in texts]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], _listed(found), pa.array([collapsed(w, f) for w, f in zip(texts, found)], pa.string())], [*piece.schema.names[:-1], "runs", "collapsed"])


def _ranges(size: int):
    """Rows (digest, text) to a row for each range of lags, of about size comparisons: (digest, ids, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0), batch.column(1)):
                ids = numbered(WORD.findall(text.as_py()))
                last = len(ids) // EXPONENT if len(ids) >= LEAST else 0
                step = max(1, size // max(1, len(ids)))
                for first in range(1, last + 1, step):
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([digest.as_py()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "first": pa.array([first], pa.int64()), "last": pa.array([min(last, first + step - 1)], pa.int64())})

    return run


def _range_scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, ids, first, last) to (digest, found)."""
    for batch in batches:
        for digest, ids, first, last in zip(*batch.columns):
            found = stretches(np.frombuffer(ids.as_py(), np.int32), first.as_py(), last.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()], pa.binary()), _listed([found])], ["digest", "found"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, a text and the stretches of all its ranges, become its runs and collapsed text."""
    for batch in batches:
        names = [*batch.schema.names[:-2], "runs", "collapsed"]
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            lists = row.column(row.num_columns - 1)[0]
            flat = lists.values if lists.is_valid else None
            found = np.stack([flat.field(c).to_numpy() for c in range(3)], axis=1) if flat is not None and len(flat) else np.zeros((0, 3), np.int64)
            words = WORD.findall(row.column(row.num_columns - 2)[0].as_py())
            found = least_lags(found)
            yield pa.RecordBatch.from_arrays([*row.columns[:-2], _listed([found]), pa.array([collapsed(words, found)], pa.string())], names)


def periodic_runs(docs: DataFrame, text: str = "text", narrow: int = NARROW, size: int = RANGE) -> DataFrame:
    """docs without text, with runs (start, length, period: every maximal run of words of least period and exponent EXPONENT or more, by start, then period) and collapsed (the words that no run repeats).

    Words are stretches of characters other than U+0020 and U+0009 to U+000D,
    numbered from 0; equal words are equal strings. Null and empty texts have no
    runs and an empty collapsed text. Every row gives one row, repeats included;
    no other column has a part in it (one named runs or collapsed goes). An empty
    table gives no rows. Texts of at most narrow characters are scanned where
    they are read. Longer ones are dealt by ranges of lags of about size comparisons, once for
    each different text, and their rows go through one exchange.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), "runs", "collapsed"}]
    plain = [f"column_{k}" for k in range(len(rest))]  # names with dots do not pass through Arrow
    kept = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(rest, plain)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), f"runs {RUNS}, collapsed string"])
    near = kept.filter(F.length("text") <= narrow).mapInArrow(_scanned, kinds)

    far = kept.filter(F.length("text") > narrow).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = far.groupBy("digest").agg(F.any_value("text").alias("text"))
    ranges = stash(texts.mapInArrow(_ranges(size), "digest binary, ids binary, first long, last long"), "ranges")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    scanned = ranges.repartition(int(parts), "digest", "first").mapInArrow(_range_scanned, f"digest binary, found {RUNS}")
    stretched = stash(scanned.groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found")), "stretches")
    drop_stash(ranges)
    wide = far.join(stretched, "digest", "left").select(*plain, "text", "found").mapInArrow(_finished, kinds)
    return near.unionByName(wide).select(*(F.col(p).alias(c) for c, p in zip(rest, plain)), "runs", "collapsed")


def _repeating(doc_id: str, text: str) -> Column:
    """The text of a document whose number says that it repeats itself: from word a on, words a to a + p - 1 over and over; other texts as they are."""
    mark = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g = F.floor(mark / 10)

    def planted(row: Column) -> Column:
        words, n = row["words"], F.size(row["words"])
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, F.get(words, i)).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")

    one = F.transform(F.array(F.struct(words.alias("words"))), lambda row: F.when(F.size(row["words"]) > 0, planted(row)).otherwise(F.lit("")))
    return F.when(F.pmod(mark, F.lit(10)) == 0, F.coalesce(F.get(one, F.lit(0)), F.lit(""))).otherwise(F.col(text))


def run_report(docs: DataFrame) -> DataFrame:
    """Documents, those chosen by the checksum of their id made to repeat themselves, with their number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text. A null id chooses nothing."""
    planted = docs.select("doc_id", _repeating("doc_id", "text").alias("text"))
    found = periodic_runs(planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # the greatest length / period; then the least start and period: a's lead over b by cross multiplication
    first = F.get(
        F.array_sort("runs", lambda a, b: F.coalesce(F.nullif(F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int"), F.lit(0)), F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)), F.signum(a["period"] - b["period"]).cast("int"))), F.lit(0)
    )
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("best"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def oracle() -> str:
    """DuckDB SQL: pairs of equal words within a quarter of the text, islands of each lag, the least lag of each stretch."""
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
marked AS (
  SELECT row_id, doc_id, h, words, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM base),
edited AS (
  SELECT row_id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE words END AS words FROM marked),
places AS (SELECT row_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM edited),
pairs AS (SELECT x.row_id, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.row_id = y.row_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {EXPONENT}),
islands AS (SELECT row_id, q, i, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row_id, q, island HAVING count(*) + q >= greatest({LEAST}, {EXPONENT} * q)),
runs AS (SELECT row_id, start, length, min(q) AS period FROM stretches GROUP BY row_id, start, length),
best AS (SELECT row_id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length / period DESC, start, period) = 1),
lines AS (SELECT row_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS written FROM runs GROUP BY row_id),
gone AS (SELECT DISTINCT row_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.row_id, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM places p ANTI JOIN gone g ON p.row_id = g.row_id AND p.i = g.i GROUP BY p.row_id)
SELECT e.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(l.written, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM edited e LEFT JOIN best b USING (row_id) LEFT JOIN lines l USING (row_id) LEFT JOIN kept k USING (row_id)"""
