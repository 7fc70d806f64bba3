"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, stash


#: Parts that the neighbours of a node are dealt to, so that a great star is not one task's.
SALTS = 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(near: DataFrame) -> DataFrame:
    """near (u, v) with m, the least v of each u: least of each part, then of the parts, sent back to all parts."""
    dealt = near.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = dealt.groupBy("u", "part").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))
    return dealt.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is tied to the least node around u."""
    return _with_least(_both(edges)).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour at most u, and u itself, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    marked = _with_least(down)
    moved = marked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(marked.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): root is the least node that node reaches; nodes without an edge have no row.

    edges: two columns of one orderable type; order, repeats and loops do not
    matter and a null end is dropped. Each round is two grouped minima, each
    joined back part by part, so no list of neighbours is ever gathered and no
    task holds all those of one node; the number of rounds grows with the logarithm of the longest path. Every round's edges
    are written to the shared folder. An empty table gives no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stash(now, "edges")
    mark = None
    while True:
        after = stash(_small_star(_large_star(now)).distinct(), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
