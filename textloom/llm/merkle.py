"""A manifest of a dataset: digests of rows in trees, and proofs for each row.

Every group of rows (a tree) hashes its rows' digests, in order, up to one; these
are in turn the leaves of a tree of trees. A node is the digest of ARITY
consecutive children, of fewer at the end of a level.

Parents are made where their children are: each digest that arrives is an event,
which goes to the partial parent that its place names. How many children that
parent has follows from the tree's size; when the last arrives, the parent is
made and is an event of the next level, so a task that has neighbouring leaves
climbs as far as they reach. What stays open is a frontier of a few nodes for
each task and level. It is dealt by the span of leaves beneath, so that what
belongs to one parent meets, and the same accumulation goes on. Every parent
keeps its children: followed downwards they give each leaf its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, stash
from textloom.llm.digests import crc32_sql

#: Children of a parent.
ARITY = 8
#: Levels that a round of the frontier resolves: a span has at most ARITY to this power nodes.
CLIMB = 6
#: Leaves of one range when they are put into order.
RANGE_ROWS = 200_000
#: Partial parents that a task keeps open before it hands them on as frontier.
MOST_OPEN = 200_000

_EVENT = "tree string, size long, level int, place long, digest string"
_NODE = f"{_EVENT}, children array<string>, made boolean"
_KIND = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("made", pa.bool_())])


def digest(columns: list[Column]) -> Column:
    """sha256 in hex over the columns, each `-` if null, else its length in bytes, `:` and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def height(size: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size = -(-size // arity)
        levels += 1
    return levels


def accumulate(events: Iterator[tuple[str, int, int, int, str]], arity: int = ARITY, most_open: int = MOST_OPEN) -> Iterator[tuple]:
    """Events (tree, size, level, place, digest) to rows (tree, size, level, place, digest, children, made): a parent made for each set of children that is complete, and last the events that wait for others, unmade. Roots have no parent and wait for none."""
    waiting: dict[tuple[str, int, int], dict[int, tuple]] = {}
    for event in events:
        while True:
            tree, size, level, place, own = event
            width = -(-size // arity**level)
            if width <= 1:
                break
            key = (tree, level + 1, place // arity)
            slots = waiting.setdefault(key, {})
            slots[place % arity] = event
            if len(slots) < min(arity, width - arity * key[2]):
                break
            del waiting[key]
            children = [slots[k][4] for k in range(len(slots))]
            event = (tree, size, level + 1, key[2], hashlib.sha256("".join(children).encode()).hexdigest())
            yield (*event, children, True)
        if len(waiting) >= most_open:
            yield from ((*e, None, False) for slots in waiting.values() for e in slots.values())
            waiting.clear()
    yield from ((*e, None, False) for slots in waiting.values() for e in slots.values())


def _accumulated(arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for row in accumulate((e for batch in batches for e in zip(*(c.to_pylist() for c in batch.columns))), arity):
            made.append(row)
            if len(made) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _KIND)], schema=_KIND)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _KIND)], schema=_KIND)

    return run


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with size, the rows of their group, and place, from 0 in order within it; written in order.

    Rows are dealt by ranges of (group, order, a number of the row), so a group
    of any size and rows alike in all columns lie in several; a place is the
    rows of the ranges before, the place in the range, less the group's start.
    """
    spark = rows.sparkSession
    given = stash(rows.withColumn("tick", F.monotonically_increasing_id()), "leaves")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // RANGE_ROWS))
    keys = [group, *order, "tick"]
    dealt = given.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    dealt = stash(dealt.drop("tick").withColumn("part", part).withColumn("at", within), "ordered")
    drop_stash(given)
    parts = dealt.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = parts.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(_running()) - F.col("n")).alias("before"))
    met = parts.join(before, "part").select("part", group, "n", (F.col("before") + F.col("least")).alias("start"), "before")
    trees = met.groupBy(group).agg(F.min("start").alias("first"), F.sum("n").alias("size"))
    shifts = met.join(trees, group).select("part", group, (F.col("before") - F.col("first")).alias("shift"), "size")
    out = stash(dealt.join(shifts, ["part", group]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "placed")
    drop_stash(dealt)
    return out


def _running():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def grow(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """All parents over leaves (tree, size, place, digest), as (tree, size, level, place, digest, children), the leaves' level being 0. A tree of one leaf has none."""
    now = leaves.select("tree", "size", F.lit(0).alias("level"), "place", "digest")
    tables, span = [], CLIMB
    while True:
        step = stash(now.mapInArrow(_accumulated(arity), _NODE), "nodes")
        tables.append(step)
        now = step.filter("not made").drop("children", "made")
        if now.isEmpty():
            break
        beneath = F.pow(F.lit(float(arity)), F.greatest(F.lit(span) - F.col("level"), F.lit(0)))  # nodes of this level in a span
        now = now.repartition("tree", F.floor(F.col("place") / beneath))
        span += CLIMB
    made = tables[0]
    for t in tables[1:]:
        made = made.unionByName(t)
    return made.filter("made").drop("made")


def _siblings(children: str, at: Column) -> Column:
    """The children before and after one of them, joined."""
    n = F.size(children)
    left = F.array_join(F.slice(F.col(children), F.lit(1), at), "")
    right = F.array_join(F.slice(F.col(children), at + 2, F.greatest(n - at - 1, F.lit(0))), "")
    return F.struct(left.alias("left"), right.alias("right"))


def climb(leaves: DataFrame, parents: DataFrame, tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """leaves with path: for each level, from the leaf's own to the last, the joined siblings before (left) and after (right) it; tops (tree, path) says how a tree's root goes on."""
    parents = stash(parents, "parents")
    root = parents.filter(F.col("place") == 0)
    most = parents.agg(F.max("level")).first()[0] or 0
    roots = root.groupBy("tree").agg(F.max("level").alias("level")).join(tops, "tree").select("tree", "level", F.lit(0).cast("long").alias("place"), "path")
    above = None
    for level in range(most, 0, -1):
        known = roots.filter(F.col("level") == level)
        if above is not None:
            at = F.col("child").cast("int")
            down = above.select("tree", F.lit(level).alias("level"), "place", "children", "path", F.posexplode("children").alias("child", "digest"))
            known = known.unionByName(down.select("tree", "level", (F.col("place") * arity + F.col("child")).alias("place"), F.concat(F.array(_siblings("children", at)), F.col("path")).alias("path")))
        above = parents.filter(F.col("level") == level).select("tree", "place", "children").join(known.drop("level"), ["tree", "place"])
    lone = leaves.filter("size = 1").join(tops, "tree")
    if above is None:
        return lone
    at = F.pmod(F.col("place"), F.lit(arity)).cast("int")
    several = leaves.filter("size > 1").withColumn("over", F.floor(F.col("place") / arity)).join(above.withColumnRenamed("place", "over"), ["tree", "over"])
    several = several.withColumn("path", F.concat(F.array(_siblings("children", at)), F.col("path"))).drop("over", "children")
    return several.unionByName(lone)


def manifest(rows: DataFrame, group: str, order: str, arity: int = ARITY) -> DataFrame:
    """rows (with leaf, a digest) with subroot, root and path, the proof: folding the leaf with each of path's (left, right) gives root.

    group: a string column; each value's rows are a tree, null's too. order: rows
    of a group go by it, nulls first, ties by leaf. Trees go by group, null first,
    then by its bytes. A row is a leaf even if another is like it in all columns;
    such rows take neighbouring places. The path's columns are joined digests;
    a level without siblings (a node alone at a level's end) has two empty ones.
    Other columns stay (but for those named subroot, root and path). An empty
    table gives no rows. No group is one task's: leaves are dealt by ranges of places.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))
    kept = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in {"subroot", "root", "path"}))
    leaves = placed(rows.select(tree.alias("tree"), F.col(order).alias("by"), F.col("leaf").alias("digest"), kept.alias("row")), "tree", ["by", "digest"])
    parents = grow(leaves, arity)
    lone = leaves.filter("size = 1").select("tree", "digest")
    highest = parents.filter("place = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    tops = placed(highest.unionByName(lone).select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), "tree", ["own"])
    over = grow(tops, arity)
    everything = tops.sparkSession.createDataFrame([("",)], "tree string").withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    paths = stash(climb(tops, over, everything, arity).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path"), "subroots")
    root = F.aggregate("path", F.col("subroot"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    found = climb(leaves, parents, paths.select("tree", "path"), arity)
    return found.join(paths.select("tree", "subroot", root.alias("root")), "tree").select("row.*", "subroot", "root", "path")


def verified(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the manifest over documents by language and id; where 3 divides the checksum of an id (never a null one), the fold starts at the leaf of the text in lower case."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate("text", upper, upper.lower())
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    leaf = digest([F.col(c) for c in names])
    start = F.when(tampered, digest([*(F.col(c) for c in names[:-1]), lowered])).otherwise(leaf)
    found = manifest(docs.select("doc_id", "lang", leaf.alias("leaf"), start.alias("start")), "lang", "doc_id")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.col("start"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """DuckDB SQL: levels by recursion over all trees at once, paths by recursion from the leaves."""

    def written(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def levels(name: str, source: str) -> str:
        return f"""{name}(tree, level, place, digest, width) AS (
  SELECT tree, 0, place, digest, count(*) OVER (PARTITION BY tree) FROM {source}
  UNION ALL
  SELECT tree, level + 1, place // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(width) + {ARITY - 1}) // {ARITY} FROM {name} WHERE width > 1 GROUP BY tree, level, place // {ARITY})"""

    def climbing(name: str, source: str, nodes: str) -> str:
        return f"""{name}(row_id, tree, level, place, digest, folded, proof) AS (
  SELECT row_id, tree, 0, place, digest, start, '' FROM {source}
  UNION ALL
  SELECT c.row_id, c.tree, c.level + 1, c.place // {ARITY}, c.digest, sha256(coalesce(s.before, '') || c.folded || coalesce(s.after, '')), c.proof || coalesce(s.before, '') || coalesce(s.after, '')
  FROM {name} c JOIN {nodes}_siblings s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place)"""

    def siblings(nodes: str) -> str:
        row = f"PARTITION BY tree, level, place // {ARITY} ORDER BY place"
        return f"""{nodes}_siblings AS (
  SELECT tree, level, place, string_agg(digest, '') OVER ({row} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, string_agg(digest, '') OVER ({row} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM {nodes} WHERE width > 1)"""

    head = [written(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || lang, '-') AS tree, sha256({' || '.join([*head, written('text')])}) AS digest,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({' || '.join([*head, written("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")])}) END AS changed FROM documents),
leaves AS (
  SELECT row_id, doc_id, tree, digest, coalesce(changed, digest) AS start, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM base),
{levels("nodes", "leaves")},
{siblings("nodes")},
{climbing("paths", "leaves", "nodes")},
subroots AS (SELECT '' AS tree, tree AS row_id, digest, digest AS start, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE width = 1),
{levels("top_nodes", "subroots")},
{siblings("top_nodes")},
{climbing("top_paths", "subroots", "top_nodes")},
ends AS (SELECT row_id, tree, folded, proof FROM paths QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
top_ends AS (SELECT row_id, proof FROM top_paths QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
steps AS (
  SELECT e.row_id, e.tree AS own, '' AS tree, 0 AS level, s.place, e.folded FROM ends e JOIN subroots s ON s.row_id = e.tree
  UNION ALL
  SELECT c.row_id, c.own, c.tree, c.level + 1, c.place // {ARITY}, sha256(coalesce(s.before, '') || c.folded || coalesce(s.after, '')) FROM steps c JOIN top_nodes_siblings s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place),
folds AS (SELECT row_id, folded FROM steps QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
root AS (SELECT digest FROM top_nodes WHERE width = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof || t.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified
FROM leaves l JOIN ends e USING (row_id) JOIN subroots s ON s.row_id = l.tree JOIN top_ends t ON t.row_id = l.tree JOIN folds f ON f.row_id = l.row_id CROSS JOIN root r"""
