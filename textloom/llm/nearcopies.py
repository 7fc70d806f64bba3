"""Near copies: SimHash probes and min-wise keys give candidates, whole shingle sets decide.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of SIMILARITY or more. Fingerprints of such pairs differ in up to a
fifth of their bits, too many for any plan of probes whose cost does not grow
with the square of the input. So the pairs that the SimHash operator finds
within TAU bits are only the first candidates. The others are texts that share
one of BANDS keys, each a hash of ROWS minima of the set under different
orders: a pair of similarity 0.8 shares none with a probability of
(1 - 0.8 ** ROWS) ** BANDS, below one in a million. Every candidate is compared
on the whole sets, so no pair below SIMILARITY is linked.

Texts of one set collapse first. Each set under a shared key is compared with
one centre, of those of its keys the one that shares most keys with others: as
a rule the original that the others were made from. What is then apart from
the centre of a key is held against the rest of the key, inside the join, by a
sketch of SKETCH one-bit minima; a pair goes on only if its sketches differ in
few enough bits for the similarity sought, and only under the first key that it
shares. A key with more than HOT sets apart is not paired off: a passage that many
texts share gives them keys in common but no likeness. Such sets meet again only
on shingles that are rare among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, map_slices, stash
from textloom.llm.components import connected_components
from textloom.llm.simhash import BLOCK_WORDS, SEED, _digest, _word_blocks, keep_first, near_pairs

SHINGLE, SIMILARITY = 5, 0.8
#: Minima of a key, keys of a set, and bits within which fingerprints are probed.
ROWS, BANDS, TAU = 3, 20, 2
#: Shingles whose orders are worked out at a time.
BLOCK = 1 << 9
#: Bits of a sketch, and those in which the sketches of a pair that goes on differ at most: the mean at SIMILARITY, and three deviations.
SKETCH = 1024
MOST_DIFFERENT = int(SKETCH * (1 - SIMILARITY) / 2 + 3 * (SKETCH * (1 - SIMILARITY) / 2 * (1 + SIMILARITY) / 2) ** 0.5)
#: Sets of a key that are apart from its centre and are held against all others of the key; where more are, rare shingles tell the sets apart.
HOT = 16
#: Ids of sets or rows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_LONGS = 1_000_000

_rng = np.random.default_rng(20071107)  # any fixed seed: keys are comparable if it stays
_ODD = (_rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

_ODD32 = (_rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
WORDS = [f"w{k}" for k in range(SKETCH // 64)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a whole text's distinct shingles, ascending; null or no word: none; fewer words than a shingle: one of them all."""
    parts, tail = [], []
    for words in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        for i in range(0, max(1, len(words) - shingle + 1), BLOCK_WORDS):
            part = words[i : i + BLOCK_WORDS + shingle - 1]
            if len(part) < shingle:
                break
            hashes = b"".join(map(_digest, map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))))
            parts.append(np.unique(np.frombuffer(hashes, ">i8").astype(np.int64)))
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not parts:
        return np.frombuffer(_digest(b" ".join(tail)) if tail else b"", ">i8").astype(np.int64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def set_id(own: np.ndarray) -> int:
    """A signed long for a set of shingles; the empty set: 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed=SEED)).astype(np.int64)) if len(own) else 0


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long; the empty set: 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(own), BLOCK_WORDS):
        ones += np.unpackbits(own[i : i + BLOCK_WORDS].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(">i8")[0])


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set as longs; the empty set has none."""
    if not len(own):
        return np.empty(0, np.int64)
    x, least = own.view(np.uint64), np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), BLOCK):
        np.minimum(least, (_ODD[:, None] * x[None, i : i + BLOCK]).min(axis=1), out=least)
    data = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[k * 8 * ROWS : (k + 1) * 8 * ROWS], seed=k) for k in range(BANDS)], np.uint64).view(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """One bit of the least shingle of a set under each of SKETCH orders, as longs; two sketches differ in (1 - similarity) / 2 of their bits on average."""
    x, least = (own.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), BLOCK):
        np.minimum(least, (_ODD32[:, None] * x[None, i : i + BLOCK]).min(axis=1), out=least)
    return np.packbits((least >> np.uint32(3)).astype(np.uint8) & np.uint8(1)).view(">i8").astype(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def mark(text: str) -> Column:
    """A long by which equal texts are told."""
    return F.xxhash64(F.col(text).cast("string"))


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, mark, sid, n, fp, bands): id, size, fingerprint and keys of each text's set of shingles. One pass, no shuffle."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), mark(text).alias("mark"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
        columns = [pa.array([f(s) for s in sets], pa.int64()) for f in (set_id, len, set_fingerprint)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, _lists([band_keys(s) for s in sets])], ["doc_id", "mark", "sid", "n", "fp", "bands"])

    return map_slices(keyed, run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, mark long, sid long, n long, fp long, bands array<long>")


def _few(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LONGS else rows


def _sizes_fit(n: str, m: str) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * SIMILARITY


def _sketches_fit(a: str, b: str) -> Column:
    """Whether sketches, named with a prefix each, differ in at most MOST_DIFFERENT bits."""
    different = F.bit_count(F.col(a + WORDS[0]).bitwiseXOR(F.col(b + WORDS[0])))
    for w in WORDS[1:]:
        different = different + F.bit_count(F.col(a + w).bitwiseXOR(F.col(b + w)))
    return different <= MOST_DIFFERENT


def _first_shared(at: str, bands: str, others: str) -> Column:
    """Whether none of the keys before place `at` is common to two lists of keys."""
    out = F.lit(True)
    for j in range(BANDS - 1):
        out = out & ((F.col(at) <= j) | (F.get(F.col(bands), F.lit(j)) != F.get(F.col(others), F.lit(j))))
    return out


def _prefixed(sketches: DataFrame, sid: str, prefix: str) -> DataFrame:
    return sketches.select(F.col("sid").alias(sid), *(F.col(w).alias(prefix + w) for w in WORDS))


def _sets(nodes: DataFrame, sids: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows (sid, own, w0, w1, …): the sets and sketches of some ids, written. Only texts of such sets are read again."""
    wanted = stash(nodes.join(sids.distinct(), "sid", "left_semi").select("mark"), "near-wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
        words = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(WORDS)).T
        return pa.RecordBatch.from_arrays([pa.array(list(map(set_id, sets)), pa.int64()), _lists(sets), *map(pa.array, words)], ["sid", "own", *WORDS])

    texts = docs.select(mark(text).alias("mark"), F.col(text).cast("string").alias("text")).join(_few(wanted), "mark", "left_semi").select("text")
    sets = stash(map_slices(texts, run, f"sid long, own array<long>, {', '.join(f'{w} long' for w in WORDS)}"), "near-sets")
    drop_stash(wanted)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets have a similarity of SIMILARITY or more, written. sets: sid, own; an id's rows are all alike."""
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-candidates")
    own = lambda sid, name: sets.join(_few(stash(pairs.select(F.col(sid).alias("sid")).distinct(), "near-wanted")), "sid", "left_semi").dropDuplicates(["sid"]).select(F.col("sid").alias(sid), F.col("own").alias(name))
    both = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = stash(both.filter(common >= (F.size("x") + F.size("y") - common) * SIMILARITY).select("a", "b"), "near-pairs")
    drop_stash(pairs)
    return found


def _close_fingerprints(nodes: DataFrame, tau: int) -> DataFrame:
    """Pairs (a, b) of set ids: one for each two fingerprints within tau bits, and each set with the least of its fingerprint."""
    least = nodes.groupBy("fp").agg(F.min("sid").alias("sid"))
    close = near_pairs(least, tau)
    two = close.join(least.select(F.col("fp").alias("a"), F.col("sid").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("sid").alias("y")), "b")
    same = nodes.select("fp", F.col("sid").alias("b")).join(least.withColumnRenamed("sid", "a"), "fp").filter("a <> b")
    return two.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.select("a", "b"))


def near_links(nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (a, b) of set ids that are near copies, enough of them to reach all that any pair of candidates reaches. nodes: sid, mark, n, fp, bands; one row a set."""
    nodes = nodes.filter("n > 0")
    keys = nodes.select("sid", "n", F.posexplode("bands").alias("at", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    rows = stash(keys.join(shared, "key"), "near-keys")
    weight = rows.groupBy("sid").agg(F.sum("held").alias("weight"))
    centres = stash(rows.join(weight, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("c")), "near-centres")
    stars = rows.join(centres, "key").groupBy("sid").agg(F.max("c").alias("c")).select(F.col("c.sid").alias("a"), F.col("sid").alias("b")).filter("a <> b")
    pairs = stash(stars.unionByName(_close_fingerprints(nodes, TAU)), "near-stars")
    sets = _sets(nodes, pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(rows.select("sid")), docs, text)
    sketches = sets.select("sid", *WORDS).dropDuplicates(["sid"])
    alike = pairs.join(_prefixed(sketches, "a", "a"), "a").join(_prefixed(sketches, "b", "b"), "b").filter(_sketches_fit("a", "b")).select("a", "b")
    links = _verified(alike, sets)
    roots = stash(connected_components(links, "a", "b"), "near-roots")
    # what is apart from the centre of a key, against the others under the key
    heads = centres.select("key", F.col("c.sid").alias("centre")).join(_named(roots, "centre", "head"), "centre", "left").select("key", F.coalesce("head", "centre").alias("head"))
    named = rows.join(_named(roots, "sid", "root"), "sid", "left").join(heads, "key").withColumn("root", F.coalesce("root", "sid"))
    named = stash(named, "near-rooted")
    # few apart: each meets the rest of the key. Many: what the key stands for is common to unlike texts, and rare shingles tell them apart
    parted = stash(named.groupBy("key").agg(F.count_if(F.col("root") != F.col("head")).alias("apart")).filter("apart > 0"), "near-parted")
    open_keys = named.join(parted, "key")
    few = open_keys.filter(F.col("apart") <= HOT).join(nodes.select("sid", "bands"), "sid").join(_prefixed(sketches, "sid", ""), "sid")
    few = stash(few, "near-few")
    apart = few.filter("root <> head").select("key", F.col("sid").alias("a"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("bands").alias("others"), *(F.col(w).alias("a" + w) for w in WORDS))
    rest = few.join(apart, "key").filter((F.col("root") != F.col("other")) & _sizes_fit("n", "m") & _sketches_fit("", "a") & _first_shared("at", "bands", "others")).select("a", F.col("sid").alias("b"))
    crowded = open_keys.filter(F.col("apart") > HOT).select("sid", "n", "root").distinct()
    more = _verified(rest.unionByName(_by_rare_shingles(crowded, sets, sketches)), sets)
    for done in (rows, centres, pairs, sets, named, parted, few, roots):
        drop_stash(done)
    return links.unionByName(more)


def _by_rare_shingles(crowded: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different components (sid, n, root) whose sizes and sketches fit, found by what is rare among these sets; written.

    A set's shingles are put in order, those of fewest of these sets first. Two
    sets of the similarity sought share one of their first n - need + 1, need
    being what a set has in common with any that is alike. So what stands in many
    texts comes last and is no key. Of a key's sets only those of different
    components meet, and only under the first key that they share.
    """
    whole = stash(sets.select("sid", "own").dropDuplicates(["sid"]).join(crowded, "sid"), "near-crowded")
    single = whole.select("sid", F.explode("own").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    ordered = single.join(common, "shingle").groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "shingle"))), lambda x: x["shingle"]).alias("shared"))
    # of the first n - need + 1 shingles those that other sets have; what no other has comes before them
    room = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("shared"))
    lists = whole.select("sid", "n", "root").join(ordered, "sid").withColumn("room", room.cast("int")).filter("room > 0")
    lists = stash(lists.select("sid", "n", "root", F.slice("shared", F.lit(1), F.col("room")).alias("prefix")), "near-prefixes")
    keys = lists.select("sid", "root", F.posexplode("prefix").alias("at", "key"))
    mixed = keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rows = stash(keys.join(mixed, "key").select("key", "at", "sid").join(lists, "sid").join(_prefixed(sketches, "sid", ""), "sid"), "near-rare")
    other = rows.select("key", F.col("at").alias("bt"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("prefix").alias("others"), *(F.col(w).alias("b" + w) for w in WORDS))
    before = F.arrays_overlap(F.slice("prefix", F.lit(1), F.col("at")), F.slice("others", F.lit(1), F.col("bt")))
    met = (F.col("sid") < F.col("b")) & (F.col("root") != F.col("other")) & _sizes_fit("n", "m") & _sketches_fit("", "b") & ~before
    found = stash(rows.join(other, "key").filter(met).select(F.col("sid").alias("a"), "b"), "near-crossing")
    for done in (whole, lists, rows):
        drop_stash(done)
    return found


def _named(roots: DataFrame, node: str, root: str) -> DataFrame:
    return roots.select(F.col("node").alias(node), F.col("root").alias(root))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, mark, sid, root), one per row of docs."""
    rows = stash(sketched(docs, doc_id, text), "near-sketches")
    nodes = stash(rows.groupBy("sid").agg(F.min("mark").alias("mark"), *(F.first(c).alias(c) for c in ("n", "fp", "bands"))), "near-nodes")
    roots = connected_components(near_links(nodes, docs, text), "a", "b")
    drop_stash(nodes)
    return rows.join(roots, rows.sid == roots.node, "left").select("doc_id", "mark", "sid", F.coalesce("root", "sid").alias("root"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    fingerprint names the text's set of shingles; component_id is the smallest
    doc_id that is reached over near copies. Texts that are null or have no
    word are copies of one another. A null doc_id counts as no name for its
    component; if all ids of one are null, so is component_id. Repeated rows
    give repeated rows; extra columns are left out; an empty table no rows.
    """
    rows = _classes(docs, doc_id, text)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("sid"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that stay of near copies: see ``simhash.keep_first``."""
    return keep_first(docs, _classes(docs, doc_id, text), doc_id, text)
