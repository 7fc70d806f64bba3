"""A stored inverted index of texts: written in batches, read by the buckets of a search's terms, refreshed in place.

A folder holds postings (a row for each term of a document, in the bucket of its
term), lengths (a row for each document), stale rows (documents of earlier
batches that a later one holds anew) and commits (a row for each finished batch:
its number, the greatest `added` in it). A batch counts once its commit is
written, so one that was broken off is as if it had not been. A search reads the
buckets of its terms, and the texts only of rows added after the last commit.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.retrieval import B, K1, MOST_TERMS, tokens
from textloom.storage import stash

#: Folders that postings are dealt to by their term; bytes of text that a partition holds about, where documents are dealt by their id.
BUCKETS, SHARE = 64, 16 << 20
_COMMITS = "batch long, mark long"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _commits(spark: SparkSession, path: str) -> tuple[list[int], int | None]:
    """Numbers of the finished batches, a row each, and the watermark: the greatest `added` that is indexed."""
    try:
        rows = spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return [], None
    return sorted(r.batch for r in rows), max((r.mark for r in rows), default=None)


def _parts(spark: SparkSession, held: int | None) -> int:
    """Partitions for so many bytes of text: the session's, and at least one for every SHARE."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(held or 0) // SHARE))


def _rows(docs: DataFrame, doc_id: str, text: str, added: str, after: int | None) -> DataFrame:
    """(doc_id, added, text) of the rows added after the watermark."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(added).cast("long").alias("added"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("added is not null")
    return rows if after is None else rows.filter(F.col("added") > after)


def _newest(rows: DataFrame, held: int | None) -> DataFrame:
    """(doc_id, added, __t: its terms), of a document's rows the last added, of equals that of the greatest text. Rows are dealt by document once, so that its terms are counted where it lies."""
    own = rows.repartition(_parts(rows.sparkSession, held), "doc_id").groupBy("doc_id").agg(F.max(F.struct("added", "text")).alias("x"))
    return own.select("doc_id", F.col("x.added").alias("added"), tokens(F.col("x.text")).alias("__t"))


def _postings(rows: DataFrame, said: Column | None = None) -> DataFrame:
    """Rows (doc_id, n, term, tf); said: the terms that are wanted (by default all)."""
    terms = F.col("__t") if said is None else said
    return rows.select("doc_id", F.size("__t").alias("n"), F.explode(terms).alias("term")).groupBy("doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))


def refresh(path: str, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", added: str = "added") -> int:
    """Indexes the rows of docs added after the watermark (with no index: all) and returns the number of the batch; -1 if there are none.

    added: an integer or time that no later row is below. A document that comes
    again replaces its earlier text. Rows without `added` are never indexed; a
    null text has no terms but counts as a document, a null doc_id is a document
    of its own. One writer at a time.
    """
    spark = docs.sparkSession
    done, mark = _commits(spark, path)
    rows = _rows(docs, doc_id, text, added, mark)
    last, held = rows.agg(F.max("added"), F.sum(F.octet_length("text"))).first()
    if last is None:
        return -1
    batch = max(done, default=-1) + 1
    new, parts = _newest(rows, held), _parts(spark, held)
    slices = max(4, -(-2 * parts // BUCKETS))  # of a bucket, by document
    _postings(new).withColumn("bucket", _bucket(F.col("term"))).repartition(parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    new.select("doc_id", F.size("__t").alias("n")).write.mode("overwrite").parquet(f"{path}/lengths/batch={batch}")
    if done:
        known = _read(spark, path, "lengths", done).select("doc_id", F.col("batch").alias("old"))
        again = known.join(new.select(F.col("doc_id").alias("__d")), F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
        again.select("doc_id", "old").write.mode("overwrite").parquet(f"{path}/stale/batch={batch}")
    spark.createDataFrame([(batch, last)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return batch


def _read(spark: SparkSession, path: str, what: str, batches: list[int]) -> DataFrame:
    """The finished batches of a table, each under its own folder, with column batch."""
    return spark.read.option("basePath", f"{path}/{what}").parquet(*(f"{path}/{what}/batch={b}" for b in batches)).withColumn("batch", F.col("batch").cast("long"))


def search(path: str, docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", added: str = "added") -> DataFrame:
    """Rows (query, doc_id, score): BM25 of every document that shares a term, equal to that over all texts. queries: query, terms (array).

    docs: the table that the index is of; only its rows added after the
    watermark are tokenised (all, if there is no index), and those replace what
    the index holds of their documents. Of a document's rows the last added
    counts; rows without `added` are no documents.
    """
    spark = docs.sparkSession
    wanted = queries.select("query", F.explode("terms").alias("term")).distinct()
    terms = [r.term for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = len(terms) <= MOST_TERMS
    done, mark = _commits(spark, path)
    rows = _rows(docs, doc_id, text, added, mark)
    fresh = _newest(rows, rows.agg(F.sum(F.octet_length("text"))).first()[0])
    held = _postings(fresh, F.filter("__t", lambda t: t.isin(terms))) if few else _postings(fresh).join(wanted.select("term").distinct(), "term", "left_semi")
    held, sizes = held.select("doc_id", "n", "term", "tf"), fresh.select("doc_id", F.size("__t").alias("n"))
    if done:
        stored, lengths = _read(spark, path, "postings", done), _read(spark, path, "lengths", done)
        if few:
            buckets = [r.b for r in wanted.select(_bucket(F.col("term")).alias("b")).distinct().collect()]
            stored = stored.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        else:
            stored = stored.join(wanted.select("term").distinct(), "term", "left_semi")
        gone = sizes.select(F.col("doc_id").alias("__d"), F.lit(None).cast("long").alias("__b"))
        if len(done) > 1:
            old = spark.read.option("basePath", f"{path}/stale").parquet(*(f"{path}/stale/batch={b}" for b in done if b != done[0]))
            gone = gone.unionByName(old.select(F.col("doc_id").alias("__d"), F.col("old").alias("__b")))
        for name, table in (("stored", stored), ("lengths", lengths)):
            left = table.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__b").isNull() | (F.col("__b") == F.col("batch"))), "left_anti")
            if name == "stored":
                held = held.unionByName(left.select("doc_id", "n", "term", "tf"))
            else:
                sizes = sizes.unionByName(left.select("doc_id", "n"))
    totals = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    held = stash(held, "held")
    asked = wanted.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS:  # a term may be in most documents, whose rows then stay where they are
        asked = F.broadcast(asked)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return held.join(asked, "term").join(F.broadcast(totals)).groupBy("query", "doc_id").agg(F.sum(weight).alias("score")).withColumnRenamed("doc_id", doc_id)
