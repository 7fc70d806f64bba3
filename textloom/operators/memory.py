"""Bi-temporal memories: id, session, kind, text, created_at, valid_from, valid_to, entity_refs, embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors

#: Kinds of memory that can be in conflict, and the cosine from which they are.
CONFLICT_KINDS, CONFLICT_COSINE = ("preference", "reference"), 0.85


def valid_at(t: Column) -> Column:
    """valid_from <= t and (valid_to is open or > t)."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def of_session(session: str | None) -> Column:
    """Rows of a session and those of none; no session: all."""
    return F.lit(True) if session is None else F.col("session").isNull() | (F.col("session") == session)


def by_entities(memories: DataFrame, entities: list[str], t: Column, n: int) -> DataFrame:
    """The first n memories, by id, that are valid at t and hold any of the entities."""
    return memories.filter(F.arrays_overlap("entity_refs", F.array(*map(F.lit, entities))) & valid_at(t)).orderBy("id").limit(n)


def invalidate(memories: DataFrame, ids: DataFrame, t: Column) -> DataFrame:
    """Closes the open ones of the given ids at t; closed ones stay as they are."""
    marked = memories.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("valid_to", F.when(F.col("__hit") & F.col("valid_to").isNull(), t).otherwise(F.col("valid_to"))).drop("__hit")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of batch instead of those of equal keys: no sort, only an anti-join."""
    return table.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def recall(ranked: DataFrame, kinds: list[str] | None, session: str | None, t: Column, k: int) -> DataFrame:
    """Of ranked memories (score): the 2 k best, then those of the kinds and session that are valid at t, at most k. May be fewer than k."""
    pool = ranked.orderBy(F.desc("score"), "id").limit(2 * k)
    wanted = of_session(session) & valid_at(t)
    if kinds:
        wanted = wanted & F.col("kind").isin(kinds)
    return pool.filter(wanted).orderBy(F.desc("score"), "id").limit(k)


def conflicts(memories: DataFrame, least: float = CONFLICT_COSINE) -> DataFrame:
    """Pairs (id, prior): same kind of those that can be in conflict, prior open and older, a shared entity, cosine of at least `least`.

    Memories of a kind and entity with equal embeddings are one where cosines are worked out, and only those
    whose embeddings are alike meet; a pair counts under its least shared entity. What is joined grows with the
    pairs that are returned (each of the entities that they share), not with all that share an entity.
    """
    own = memories.filter(F.col("kind").isin(*CONFLICT_KINDS) & F.col("embedding").isNotNull())
    e = own.select("id", "kind", "created_at", F.col("valid_to").isNull().alias("open"), "entity_refs", "embedding", F.unhex(F.sha2(F.to_json("embedding"), 256)).alias("v"), F.explode(F.array_distinct("entity_refs")).alias("e"))
    held = e.groupBy("kind", "e", "v").agg(F.max("open").alias("open"), F.first("embedding").alias("embedding"))
    other = held.filter("open").select("kind", "e", F.col("v").alias("__v"), F.col("embedding").alias("__embedding"))
    alike = held.join(other, ["kind", "e"]).select("kind", "e", "v", "__v", vectors.cosine(F.col("embedding"), F.col("__embedding")).alias("cosine")).filter(F.col("cosine") >= least)
    prior = e.filter("open").select("kind", "e", F.col("v").alias("__v"), F.col("id").alias("prior"), F.col("created_at").alias("__at"), F.col("entity_refs").alias("__refs"))
    met = e.drop("open", "embedding").join(alike, ["kind", "e", "v"]).join(prior, ["kind", "e", "__v"]).filter(F.col("__at") < F.col("created_at"))
    return met.filter(F.col("e") == F.array_min(F.array_intersect("entity_refs", "__refs"))).select("id", "prior", "cosine")


def forget(memories: DataFrame, tokens: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories without the given ids, and the tokens (token) that any of those left still holds in entity_refs."""
    left = memories.join(ids.select("id"), "id", "left_anti")
    return left, tokens.join(left.select(F.explode("entity_refs").alias("token")).distinct(), "token", "left_semi")


def reference_count(memories: DataFrame, token: str) -> DataFrame:
    """Memories that hold a token, each once."""
    return memories.agg(F.count_if(F.exists("entity_refs", lambda t: t == token)).alias("n"))


def graph_recall(memories: DataFrame, seeds: list[str], t: Column, hops: int = 2, per_hop: int = 50) -> DataFrame:
    """Rows (entity, hop, mentions): entities met within so many hops of shared memories, at most per_hop memories a hop in order of id."""
    spark = memories.sparkSession
    live = memories.filter(valid_at(t)).select("id", "entity_refs")
    seen = spark.createDataFrame([(s, 0) for s in seeds], "entity string, hop int")
    frontier = seen.select("entity")
    for hop in range(1, hops + 1):
        hit = live.join(live.select("id", F.explode("entity_refs").alias("entity")).join(frontier, "entity", "left_semi").select("id").distinct(), "id", "left_semi").orderBy("id").limit(per_hop)
        new = hit.select(F.explode("entity_refs").alias("entity")).distinct().join(seen, "entity", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(new)
        frontier = new.select("entity")
    mentions = live.select(F.explode(F.array_distinct("entity_refs")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    return seen.join(mentions, "entity", "left").fillna(0, ["mentions"])


def next_version(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row of each key by version."""
    return cells.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))).filter("__k = 1").drop("__k")
