"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into groups of correlated bits. If the groups'
thresholds sum to tau - groups + 1, two fingerprints within tau bits are within
the threshold in at least one group (-1: a group that need not be probed).
The number of groups and the thresholds come from a dynamic program over the
probes and the estimated candidate pairs. Candidates are then verified.

A bucket of more than ``hot`` fingerprints is never paired off: its members
are keyed by a further third of the bits, and those that are still in such a
bucket are probed with every value within tau bits, which is an equality join.
All three levels are exact, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, map_slices, stash, unused
from textloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
#: Words of a text that are hashed at a time.
BLOCK_WORDS = 100_000
#: Bytes of a text that are split into words at a time.
BLOCK_BYTES = 4 << 20
#: What a probe row and a verified candidate cost, in relation.
PROBE_COST, PAIR_COST = 1.0, 0.25
#: Rows (ids and marks) up to which those that go are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_digest = partial(xxhash.xxh64_digest, seed=SEED)


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; bytes.split() cuts at exactly 0x20 and 0x09-0x0D."""
    if len(data) <= BLOCK_BYTES:
        yield data.split()
        return
    at, rest = 0, b""
    while at < len(data):
        piece = rest + data[at : at + BLOCK_BYTES]
        at += BLOCK_BYTES
        if at < len(data):
            words = piece.split()
            if piece[-1:].isspace() or not words:
                rest = b""
            else:
                rest = words.pop()
            yield words
        else:
            yield piece.split()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit number; null or no word: 0; fewer words than a shingle: one shingle of them all."""
    if not text:
        return 0
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        for i in range(0, max(1, len(words) - shingle + 1), BLOCK_WORDS):
            part = words[i : i + BLOCK_WORDS + shingle - 1]
            if len(part) < shingle:
                break
            hashes = b"".join(map(_digest, map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))))
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total:
        if not tail:
            return 0
        return int.from_bytes(_digest(b" ".join(tail)), "big")
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, mark, fp): fp is the fingerprint as a signed long, mark xxhash64 of the text. One row per input row, repeats, null ids and null texts included; an empty table gives no rows."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "mark", "fp"])

    return map_slices(keyed, run, f"doc_id {id_type}, mark long, fp long")


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the 64 x 64 matrix of how many have both bits set; 64 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(x), 1 << 18):
                bits = np.unpackbits(x[i : i + (1 << 18)], axis=1).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)  # below 2 ** 24, so exact
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([n] * 64), pa.array(both.tolist(), pa.list_(pa.int64()))], ["bit", "n", "with_"])

    parts = fps.select("fp").mapInArrow(count, "bit long, n long, with_ array<long>")
    rows = parts.groupBy("bit").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("with_")[j]) for j in range(64))).alias("with_")).collect()
    out = np.zeros((64, 64))
    for r in rows:
        out[r.bit] = r.with_
    return (rows[0].n if rows else 0), out


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits 0 (highest) to 63 in groups of nearly equal size; each group grows from the most correlated bit left by those most correlated with it."""
    if n == 0:
        return [list(map(int, x)) for x in np.array_split(np.arange(64), groups)]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for g in range(groups):
        want = len(left) // (groups - g)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(own) < want:
            own.append(max((b for b in left if b not in own), key=lambda b: (corr[b, own].mean(), -b)))
        left = [b for b in left if b not in own]
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1, one per group, that sum to total at the least cost; costs[i][t + 1] is that of group i at t. Ties: the first in group order."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, ts) in best.items():
            for t in range(-1, len(own) - 1):
                new = (cost + own[t + 1], [*ts, t])
                if had + t not in step or new < step[had + t]:
                    step[had + t] = new
        best = step
    return best[total]


def _mask(bits: list[int]) -> int:
    """The signed 64-bit mask of bit numbers counted from the highest."""
    m = sum(1 << (63 - b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def plan_probes(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group to probe. Pairs that agree in a whole group are counted over all fingerprints; those within t bits are estimated from that count and how often each bit agrees."""
    n, both = _bit_statistics(fps)
    if n < 2:
        return []
    p = np.diag(both) / n
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1)
    found: tuple[float, list[tuple[list[int], int]]] | None = None
    layouts = {m: group_bits(n, both, m) for m in range(1, tau + 2)}
    keys = [(m, i, _mask(g)) for m, gs in layouts.items() for i, g in enumerate(gs)]
    sizes = (
        fps.select(F.inline(F.array(*(F.struct(F.lit(m * 100 + i).alias("g"), F.col("fp").bitwiseAND(F.lit(k)).alias("v")) for m, i, k in keys))))
        .groupBy("g", "v")
        .count()
        .groupBy("g")
        .agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    )
    pairs = {r.g: r.pairs for r in sizes.collect()}
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            odds = [(1 - a) / a for a in agree[g]]
            near, own = [1.0], [0.0]
            for t in range(1, tau + 1):  # elementary symmetric sums: t of the bits disagree
                near.append(sum(float(np.prod(c)) for c in combinations(odds, t)) if t == 1 else near[1] ** t / np.prod(range(1, t + 1)))
            for t in range(tau + 1):
                own.append(PROBE_COST * n * sum(comb(len(g), k) for k in range(t + 1)) + PAIR_COST * pairs.get(m * 100 + i, 0.0) * sum(near[: t + 1]))
            costs.append(own)
        cost, ts = allocate(costs, tau - m + 1)
        if found is None or cost < found[0]:
            found = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return found[1]


def _flips(bits: list[int], most: int) -> list[int]:
    """The masks of every set of at most `most` of the bits."""
    return [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def _pairs(index: DataFrame, probe: DataFrame, tau: int) -> DataFrame:
    """Verified pairs a < b of fingerprints under one key."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return index.select("g", "v", F.col("fp").alias("a")).join(probe.select("g", "v", F.col("fp").alias("b")), ["g", "v"]).filter((F.col("a") < F.col("b")) & close).select("a", "b")


def near_pairs(fps: DataFrame, tau: int = 2, hot: int = 256) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct long values in column fp that differ in 1 to tau bits.

    Exact whatever the spread of the values; a null fp has no pair; no value
    or one value: no rows. hot: fingerprints under one key beyond which the
    key is made longer instead of pairing them off.
    """
    fps = fps.select("fp").filter("fp is not null")
    plan = plan_probes(fps, tau)
    spark = fps.sparkSession
    if not plan:
        return spark.createDataFrame([], "a long, b long")
    masks = {i: _mask(g) for i, (g, _) in enumerate(plan)}

    def level(keys: list[tuple[int, int, list[int]]], source: DataFrame) -> DataFrame:
        """source has fp and q, the probed value; a row for each (number, mask, flips) of keys: g, v = (q with a flip) & mask."""
        rows = [F.struct(F.lit(g).alias("g"), F.col("q").bitwiseXOR(F.lit(f)).bitwiseAND(F.lit(m)).alias("v"), F.col("q").bitwiseXOR(F.lit(f)).alias("q")) for g, m, fs in keys for f in fs]
        return source.select("fp", F.inline(F.array(*rows)).alias("g", "v", "q"))

    exact = fps.withColumn("q", F.col("fp"))
    index = level([(i, masks[i], [0]) for i in masks], exact)
    probe = level([(i, masks[i], _flips(g, t)) for i, (g, t) in enumerate(plan)], exact)
    found = None
    for depth in range(2):
        hot_keys = stash(index.groupBy("g", "v").count().filter(F.col("count") > hot).select("g", "v"), "hot-keys")
        none = hot_keys.isEmpty()
        cold_i, cold_p = (index, probe) if none else (index.join(hot_keys, ["g", "v"], "left_anti"), probe.join(hot_keys, ["g", "v"], "left_anti"))
        new = _pairs(cold_i, cold_p, tau)
        found = new if found is None else found.unionByName(new)
        if none:
            return found.distinct()
        longer = []
        rests = {}
        for g, m in masks.items():
            free = [b for b in range(64) if not (m >> (63 - b)) & 1]
            for j, own in enumerate(np.array_split(np.array(free), tau + 1)):
                rests[g * 10 + j + 1] = (g, _mask([b for b in range(64) if (m >> (63 - b)) & 1] + own.tolist()))
        longer = rests

        def deeper(rows: DataFrame, longer=longer, hot_keys=hot_keys) -> DataFrame:
            rows = rows.join(hot_keys, ["g", "v"], "left_semi")
            subs = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(g).alias("g0"), F.lit(m).alias("m")) for n, (g, m) in longer.items())), lambda s: s.g0 == F.col("g"))
            return rows.select("fp", "q", F.explode(subs).alias("s")).select("fp", F.col("s.n").alias("g"), F.col("q").bitwiseAND(F.col("s.m")).alias("v"), "q")

        index, probe = deeper(index), deeper(probe)
        masks = {n: m for n, (_, m) in longer.items()}
    # Still too many under a key: probe every value within tau bits of the free ones.
    hot_keys = stash(index.groupBy("g", "v").count().filter(F.col("count") > hot).select("g", "v"), "hot-keys")
    found = found.unionByName(_pairs(index.join(hot_keys, ["g", "v"], "left_anti"), probe.join(hot_keys, ["g", "v"], "left_anti"), tau))
    if not hot_keys.isEmpty():
        every = [F.when(F.col("g") == g, F.array(*map(F.lit, _flips([b for b in range(64) if not (m >> (63 - b)) & 1], tau)))) for g, m in masks.items()]
        index = index.join(hot_keys, ["g", "v"], "left_semi").select("g", F.col("fp").alias("v"), "fp")
        probe = probe.join(hot_keys, ["g", "v"], "left_semi").select("g", F.explode(F.coalesce(*every)).alias("flip"), "q", "fp").select("g", F.col("q").bitwiseXOR(F.col("flip")).alias("v"), "fp")
        found = found.unionByName(_pairs(index, probe, tau))
    return found.distinct()


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, tau: int, hot: int) -> DataFrame:
    """Rows (doc_id, mark, fp, root), one per row of docs; mark is xxhash64 of the text, root names the component."""
    fps = stash(fingerprints(docs, doc_id, text, shingle), "simhash")
    nodes = stash(fps.select("fp").distinct(), "simhash-distinct")
    roots = connected_components(near_pairs(nodes, tau, hot), "a", "b")
    return fps.join(roots, fps.fp == roots.node, "left").select("doc_id", "mark", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 2, hot: int = 256, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    component_id is the smallest doc_id whose fingerprint is reached over
    links of at most tau bits. Texts that are null or have no word share the
    fingerprint zero. A null doc_id counts as no name for its component; if
    all ids of one are null, so is component_id. Repeated rows give repeated
    rows; extra columns are left out; an empty table gives no rows.
    """
    fps = stash(fingerprints(docs, doc_id, text, shingle).drop("mark"), "simhash")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(near_pairs(nodes, tau, hot), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 2, hot: int = 256, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with their columns, that stay of near duplicates by fingerprints: see ``keep_first``."""
    return keep_first(docs, _classes(docs, doc_id, text, shingle, tau, hot), doc_id, text)


def keep_first(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of docs, with all its columns, for each root of classes (doc_id, mark, root; a row for each row of docs).

    It is that of the least doc_id, null ids last; of unlike texts under that
    id the one of the least mark; of repeated rows any one. An id that stands
    in several classes stays once in each of which it is the least. Texts are
    shuffled only where more than BROADCAST_ROWS rows go.
    """
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    counted = stash(classes.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies")), "classes")
    first = counted.groupBy("root").agg(F.min(named).alias("f"))
    told = counted.join(first, "root").select("doc_id", "mark", "copies", (named == F.col("f")).alias("stays"))
    own, text_mark = (unused(name, docs.columns) for name in ("__id", "__mark"))
    apart = stash(told.filter("copies > 1 or not stays").select(F.col("doc_id").alias(own), F.col("mark").alias(text_mark), "stays"), "taken-out")
    drop_stash(counted)

    def few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    same = F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text).cast("string")) == F.col(text_mark))
    kept = docs.join(few(apart.drop("stays")), same, "left_anti")
    repeated = apart.filter("stays").select(own, text_mark)
    if repeated.isEmpty():
        return kept
    again = docs.join(few(repeated), same).dropDuplicates([own, text_mark]).drop(own, text_mark)
    return kept.unionByName(again)
