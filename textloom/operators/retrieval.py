"""Ranking of texts and vectors: cosine top-k, BM25, reciprocal-rank fusion, hybrid search, reranking, filters and pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import stash

#: Constant of reciprocal-rank fusion and of BM25, as published.
RRF, K1, B = 60, 1.2, 0.75
#: Queries of a block, whose vectors are sent to every task, and distinct terms of queries that go in a filter.
BLOCK_QUERIES, MOST_TERMS = 1_000, 1_000
#: Digits to which cosines are rounded, so that equal vectors tie whatever batch they lie in.
DIGITS = 12


def _units(vectors: list, size: int) -> np.ndarray:
    """Rows of unit length; null vectors, those of another size and zeros: zeros."""
    out = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == size and None not in v:
            out[k] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query, vec_id, score, rank) of the k nearest vectors of each query by cosine; ties: the lesser id.

    The stated queries go in blocks of at most about BLOCK_QUERIES to every
    task and meet all vectors there, batch by batch; of each batch k rows a
    query are shuffled. A block's result is written before the next begins.
    With a null vector, a zero one or one of another length the cosine is 0.
    """
    spark = corpus.sparkSession
    q = queries.select(F.col(vec_id).alias("query"), F.col(embedding).alias("__q"))
    kinds = f"query {q.schema['query'].dataType.simpleString()}, {vec_id} {corpus.schema[vec_id].dataType.simpleString()}, score double"
    blocks, found = max(1, -(-q.count() // BLOCK_QUERIES)), None
    for block in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        ids, size = [r.query for r in rows], max((len(r["__q"] or ()) for r in rows), default=0)
        units = _units([r["__q"] for r in rows], size)

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, size=size, units=units) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_pylist()
                scores = np.round(units @ _units(batch.column(1).to_pylist(), size).T, DIGITS)
                place = np.argsort(np.array(own), kind="stable").argsort() if None not in own else np.arange(len(own))
                out: tuple[list, list, list] = ([], [], [])
                for i, row in enumerate(scores):
                    at = np.arange(len(row))
                    if len(row) > k:  # all that tie with the k-th, then by id
                        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    at = at[np.lexsort((place[at], -row[at]))][:k]
                    out[0].extend([ids[i]] * len(at))
                    out[1].extend(at.tolist())
                    out[2].extend(row[at].tolist())
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), batch.column(0).take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.float64())], ["query", vec_id, "score"])

        top = _top(corpus.select(vec_id, embedding).mapInArrow(nearest, kinds), "query", k, F.desc("score"), vec_id) if rows else spark.createDataFrame([], f"{kinds}, rank int")
        top = stash(top, "nearest") if blocks > 1 else top
        found = top if found is None else found.unionByName(top)
    return found


def _top(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """Rows (query, doc_id, score): Okapi BM25 of every document that shares a term. queries: query, terms (array).

    allowed: ids to which the result is restricted before anything is ranked;
    document lengths and frequencies cover all documents all the same. The
    texts are read once: what is left of each is its length and its wanted terms.
    """
    wanted = queries.select("query", F.explode("terms").alias("term")).distinct()
    terms = [r.term for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    words = docs.select(F.col(doc_id), tokens(F.col(text)).alias("__t"))
    if len(terms) <= MOST_TERMS:
        held = F.filter("__t", lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")
        narrow = stash(words.select(doc_id, F.size("__t").alias("__n"), held.alias("__t")), "postings")
    else:
        narrow = words.select(doc_id, F.size("__t").alias("__n"), "__t")
    totals = narrow.agg(F.count(F.lit(1)).alias("docs"), F.avg("__n").alias("mean"))
    postings = narrow.select(doc_id, "__n", F.explode("__t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy(doc_id, "__n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None:
        postings = restrict(postings, allowed, doc_id)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__n") / F.col("mean")))
    return postings.join(df, "term").join(wanted, "term").join(F.broadcast(totals)).groupBy("query", doc_id).agg(F.sum(weight).alias("score"))


def fuse(arms: list[DataFrame], doc: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked rows (query, doc, rank from 1): sum of 1 / (60 + rank) over the arms, the k best of each query; ties: the lesser doc."""
    rows = arms[0].select("query", doc, "rank")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select("query", doc, "rank"))
    rows = rows.repartition("query", doc)  # a union of arms that are each dealt by query passes for dealt by query, though adaptive plans may have cut each arm otherwise
    scored = rows.groupBy("query", doc).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))
    return _top(scored, "query", k, F.desc("score"), doc)


def keyword_arm(docs: DataFrame, queries: DataFrame, pool: int, doc_id: str = "doc_id", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """The pool of best documents of each query by BM25, ranked; of the allowed ones if given."""
    return _top(bm25(docs, queries, doc_id, text, allowed), "query", pool, F.desc(F.round("score", 9)), doc_id)


def vector_arm(vectors: DataFrame, queries: DataFrame, pool: int, doc_id: str = "doc_id", embedding: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """The pool of nearest documents of each query by cosine, ranked; of the allowed ones if given. vectors: doc_id, embedding; queries: query, embedding."""
    if allowed is not None:
        vectors = restrict(vectors, allowed, doc_id)
    named = vectors.select(F.col(doc_id).alias("__doc"), F.col(embedding).alias("__v"))
    wanted = queries.select(F.col("query").alias("__doc"), F.col(embedding).alias("__v"))
    return cosine_top_k(named, wanted, pool, "__doc", "__v").withColumnRenamed("__doc", doc_id)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, pool: int = 50, doc_id: str = "doc_id", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """Rows (query, doc_id, score, rank): the k best of a keyword and a vector arm, fused by reciprocal ranks.

    queries: query, terms, embedding. allowed restricts both arms before they
    are ranked, so a selective filter still fills k: pass the ids of a
    document, a folder, or of memories of a kind and session.
    """
    arms = [keyword_arm(docs, queries, pool, doc_id, text, allowed), vector_arm(vectors, queries, pool, doc_id, allowed=allowed)]
    return fuse(arms, doc_id, k)


def rerank(pool: DataFrame, docs: DataFrame, scorer: Column, k: int, doc_id: str = "doc_id") -> DataFrame:
    """Rows (query, doc_id, score, rank): the k best of a pool by a score of their own. pool: query, doc_id and what the scorer reads of the query; scorer: a column over that and docs, as a pandas UDF may be. Ties: the lesser id."""
    scored = pool.drop("score", "rank").join(docs, doc_id).withColumn("score", scorer)
    return _top(scored.select("query", doc_id, "score"), "query", k, F.desc("score"), doc_id)


def search_objects(docs: DataFrame, queries: DataFrame, objects: DataFrame, k: int, sources: list[str] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Rows (query, doc_id, score, rank) and the columns of objects: keyword hits joined to what is known of them, of the given sources only, the k best."""
    known = objects if sources is None else objects.filter(F.col("source").isin(sources))
    return _top(bm25(docs, queries, doc_id).join(known, doc_id), "query", k, F.desc(F.round("score", 9)), doc_id)


def trigram_arm(docs: DataFrame, queries: DataFrame, pool: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pool of documents that share most distinct three-letter beginnings with the terms, ranked: a second arm that needs no vectors."""
    stems = lambda c: F.array_distinct(F.transform(c, lambda w: F.substring(w, 1, 3)))
    wanted = queries.select("query", F.explode(stems(F.col("terms"))).alias("stem"))
    held = docs.select(doc_id, F.explode(stems(tokens(F.col(text)))).alias("stem"))
    shared = held.join(wanted, "stem").groupBy("query", doc_id).agg(F.count(F.lit(1)).alias("score"))
    return _top(shared, "query", pool, F.desc("score"), doc_id)


def restrict(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed (none allowed: none)."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def keyset_page(rows: DataFrame, size: int, order: str, tie: str, after: tuple | None = None) -> DataFrame:
    """A page in descending order; after: order and tie value of the last row of the page before."""
    if after is not None:
        rows = rows.filter((F.col(order) < F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(tie) > F.lit(after[1]))))
    return rows.orderBy(F.col(order).desc(), tie).limit(size)


def under_folder(path: Column, root: str) -> Column:
    """path is root or below it; case and the kind of slash do not matter, and /a does not hold /ab."""
    plain, top = F.lower(F.translate(path, "\\", "/")), root.lower().replace("\\", "/").rstrip("/")
    return (plain == top) | plain.startswith(top + "/")
