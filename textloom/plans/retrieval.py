"""Queries over retrieval, memory, graph, span and review-grid operators on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import graph, memory, retrieval, spans, tabular
from textloom.plans.tables import dealt, table

# -- frames made of the supplied tables, and the same in SQL

MEM_SQL = """m0 AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 's' || (conv_id % 10) END AS session, ['preference', 'reference', 'fact'][turn % 3 + 1] AS kind, conv_id + turn AS created_at, conv_id AS valid_from,
CASE WHEN (conv_id * 1000 + turn) % 3 = 0 THEN conv_id + 40 END AS valid_to, list_distinct(list_filter(string_split(lower(text), ' ')[1:3], lambda x: x <> '')) AS refs FROM conversations)"""
SPAN_SQL = """sp AS (SELECT l_orderkey AS k, l_linenumber AS id, (l_linenumber * 7 + l_suppkey % 9)::BIGINT AS s, (l_linenumber * 7 + l_suppkey % 9 + l_partkey % 13 + 1)::BIGINT AS e, l_returnflag AS label, l_discount AS confidence FROM lineitem)"""
CELL_SQL = "cells AS (SELECT o_custkey AS row_id, (o_orderkey % 4)::INT AS col_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey)::INT AS version, '\"' || o_orderpriority || '\"' AS value_json FROM orders)"


LINES_SQL = "li AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)"


def lines(s: SparkSession, d: str) -> DataFrame:
    """One row for each order and line number, which the table may repeat, dealt by order."""
    columns = ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return dealt(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *columns), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in columns))


def memories(s: SparkSession, d: str) -> DataFrame:
    cid, turn = F.col("conv_id"), F.col("turn")
    refs = F.array_distinct(F.filter(F.slice(F.split(F.lower("text"), " "), 1, 3), lambda w: w != ""))
    return table(s, d, "conversations").select(
        (cid * 1000 + turn).alias("id"), F.when(cid % 4 != 0, F.concat(F.lit("s"), cid % 10)).alias("session"), F.element_at(F.array(*map(F.lit, ("preference", "reference", "fact"))), (turn % 3 + 1).cast("int")).alias("kind"),
        (cid + turn).alias("created_at"), cid.alias("valid_from"), F.when((cid * 1000 + turn) % 3 == 0, cid + 40).alias("valid_to"), refs.alias("entity_refs"),
    )


def line_spans(s: SparkSession, d: str) -> DataFrame:
    """A span for each row of the table, dealt by order."""
    start = F.col("l_linenumber") * 7 + F.col("l_suppkey") % 9
    own = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), start.cast("long").alias("start"), (start + F.col("l_partkey") % 13 + 1).cast("long").alias("end"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("confidence"))
    return dealt(own, "k")


def cells(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(s, d, "orders").select(F.col("o_custkey").alias("row_id"), (F.col("o_orderkey") % 4).cast("int").alias("col_id"), "o_orderkey", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("value_json"))
    return o.withColumn("version", F.row_number().over(Window.partitionBy("row_id", "col_id").orderBy("o_orderkey"))).drop("o_orderkey")


def legal_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as parties, orders as documents, lines as chunks and, where returned, risks; parts as articles."""
    o, li = table(s, d, "orders"), lines(s, d)
    doc = lambda c: F.concat(F.lit("o"), F.col(c))
    chunk = F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber")
    null = F.lit(None).cast("string")
    nodes = o.select(F.lit("Document").alias("label"), doc("o_orderkey").alias("id"), doc("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))).alias("props"))
    nodes = nodes.unionByName(table(s, d, "customer").select(F.lit("Party").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("id"), null.alias("doc_id"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("props")))
    nodes = nodes.unionByName(li.select(F.lit("Chunk").alias("label"), chunk.alias("id"), doc("l_orderkey").alias("doc_id"), F.lit("{}").alias("props")))
    severity = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    nodes = nodes.unionByName(li.filter("l_returnflag = 'R'").select(F.lit("Risk").alias("label"), F.concat(F.lit("r"), chunk).alias("id"), doc("l_orderkey").alias("doc_id"), F.to_json(F.struct(severity.alias("severity"))).alias("props")))
    nodes = nodes.unionByName(li.filter("l_linestatus = 'F'").select(F.lit("Obligation").alias("label"), F.concat(F.lit("b"), chunk).alias("id"), doc("l_orderkey").alias("doc_id"), F.to_json(F.struct(F.col("l_returnflag").alias("kind"))).alias("props")))
    edge = lambda df, a, b, kind, of: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), of.alias("doc_id"))
    edges = edge(o, F.concat(F.lit("c"), "o_custkey"), doc("o_orderkey"), "PARTY_TO", doc("o_orderkey")).unionByName(edge(li, doc("l_orderkey"), chunk, "HAS_CHUNK", doc("l_orderkey")))
    edges = edges.unionByName(edge(li.filter("l_returnflag = 'R'"), doc("l_orderkey"), F.concat(F.lit("r"), chunk), "HAS_RISK", doc("l_orderkey")))
    bound = li.filter("l_linestatus = 'F'").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.unionByName(edge(bound, F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("b"), chunk), "BOUND_BY", doc("l_orderkey")))
    edges = edges.unionByName(edge(li.filter("l_linestatus = 'F' AND l_linenumber % 2 = 1"), chunk, F.concat(F.lit("b"), chunk), "MENTIONS", doc("l_orderkey")))
    article = F.concat(F.lit("a"), F.col("l_partkey") % 500)
    edges = edges.unionByName(edge(li, chunk, article, "MENTIONS", doc("l_orderkey"))).unionByName(edge(li, doc("l_orderkey"), article, "REFERENCES", doc("l_orderkey")).distinct())
    return nodes, edges


# -- queries

QUERY_SQL = "q(query, term) AS (VALUES ('q1', 'the'), ('q1', 'tion'), ('q1', 'thon'), ('q2', 'der'), ('q2', 'lich'))"
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
BM25_SQL = f"""{QUERY_SQL}, t AS (SELECT doc_id, {WORDS} AS t FROM documents), n AS (SELECT doc_id, len(t) AS n, t FROM t), tot AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
bm AS (SELECT query, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM p JOIN df USING (term) JOIN q USING (term), tot GROUP BY ALL)"""


def query_terms(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("q1", ["the", "tion", "thon"]), ("q2", ["der", "lich"])], "query string, terms array<string>")


def bm25_scores(s, d):
    return retrieval.bm25(table(s, d, "documents"), query_terms(s)).withColumn("score", F.round("score", 6))


def keyword_top_k(s, d):
    return retrieval.keyword_arm(table(s, d, "documents"), query_terms(s), 10).select("query", "doc_id", "rank")


def hybrid_search_rrf(s, d):
    docs = table(s, d, "documents")
    arms = [retrieval.keyword_arm(docs, query_terms(s), 50), retrieval.trigram_arm(docs, query_terms(s), 50)]
    return retrieval.fuse(arms, "doc_id", 10).select("query", "doc_id", F.round("score", 9).alias("score"))


def filtered_search(s, d):
    docs = table(s, d, "documents")
    allowed = docs.filter("lang = 'en'").select("doc_id")
    return retrieval.keyword_arm(docs, query_terms(s), 50, allowed=allowed).select("query", "doc_id", "rank")


def query_vectors(s: SparkSession, d: str) -> DataFrame:
    """The queries with terms and the vectors 20 and 40."""
    e = table(s, d, "embeddings").filter("vec_id IN (20, 40)")
    return query_terms(s).join(e.select(F.when(F.col("vec_id") == 20, "q1").otherwise("q2").alias("query"), "embedding"), "query")


def _hybrid(s: SparkSession, d: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.hybrid(table(s, d, "documents"), vectors, query_vectors(s, d), k, allowed=allowed).select("query", "doc_id", F.round("score", 9).alias("score"), "rank")


def hybrid_vector_search(s, d):
    return _hybrid(s, d, 10)


def hybrid_filtered_search(s, d):
    return _hybrid(s, d, 20, table(s, d, "documents").filter("lang = 'de'").select("doc_id"))


def hybrid_document_search(s, d):
    return _hybrid(s, d, 10, table(s, d, "documents").filter("doc_id IN (3, 20, 41, 77, 110, 150)").select("doc_id"))


def memory_hybrid_search(s, d):
    texts = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    e = table(s, d, "embeddings")
    vectors = texts.select("id", (F.col("id") % 499).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    live = memories(s, d).filter(memory.valid_at(F.lit(60)) & F.col("kind").isin("preference", "fact")).select("id")
    return retrieval.hybrid(texts, vectors, query_vectors(s, d), 10, doc_id="id", allowed=live).select("query", "id", F.round("score", 9).alias("score"), "rank")


def reranked_search(s, d):
    pool = retrieval.keyword_arm(table(s, d, "documents"), query_terms(s), 40)
    closeness = 1.0 / (1 + F.abs(F.length("text") - 900))
    return retrieval.rerank(pool, table(s, d, "documents").select("doc_id", "text"), closeness, 5).select("query", "doc_id", "rank")


def search_objects(s, d):
    objects = table(s, d, "documents").select("doc_id", "source", "lang")
    sources = ["src1", "src3", "src7"]
    return retrieval.search_objects(table(s, d, "documents"), query_terms(s), objects, 8, sources).select("query", "doc_id", "source", "rank")


def vector_top_k(s, d):
    e = table(s, d, "embeddings")
    top = retrieval.cosine_top_k(e, e.filter("vec_id % 20 = 0"), 5)
    return top.select("query", "vec_id", "rank", F.round("score", 5).alias("score"))


def keyset_page(s, d):
    return retrieval.keyset_page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey", (200000.0, 0))


def folder_subtree(s, d):
    path = F.regexp_replace("url", "^https?://", "/")
    return table(s, d, "pages").filter(retrieval.under_folder(path, "/m.free-bets.example.com") | retrieval.under_folder(path, "/blog.ththan.example.net/en")).select("page_id")


def memories_by_entity(s, d):
    return memory.by_entities(memories(s, d), ["the", "de", "and"], F.lit(60), 100).select("id", "kind")


def memory_point_in_time(s, d):
    return memories(s, d).filter(memory.valid_at(F.lit(50)) & memory.of_session("s3")).select("id", "valid_from")


def memory_recall(s, d):
    ranked = memories(s, d).withColumn("score", (F.col("id") * 7919 % 1000) / 1000.0)
    return memory.recall(ranked, ["preference", "fact"], "s1", F.lit(30), 200).select("id", "score")


def memory_invalidate(s, d):
    m = memories(s, d)
    return memory.invalidate(m, m.filter("id % 7 = 0").select("id"), F.lit(99).cast("bigint")).select("id", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


def memory_upsert(s, d):
    m = memories(s, d).select("id", "kind")
    return memory.upsert(m, m.filter("id % 5 = 0").withColumn("kind", F.lit("changed")), ["id"])


def memory_conflicts(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    m = memories(s, d).withColumn("v", F.col("id") % 10).join(e, F.col("v") == F.col("vec_id")).drop("v", "vec_id")
    return memory.conflicts(m, 0.5).select("id", "prior", F.round("cosine", 5).alias("cosine"))


def memory_forget(s, d):
    m = memories(s, d)
    tokens = m.select(F.explode("entity_refs").alias("token")).distinct()
    return memory.forget(m, tokens, m.filter("id % 2 = 0").select("id"))[1]


def token_references(s, d):
    return memory.reference_count(memories(s, d), "the")


def party_dossier(s, d):
    return graph.party_dossier(*legal_graph(s, d), "c1")


def obligations_owed(s, d):
    return graph.obligations_of(*legal_graph(s, d), "c1")


def citation_chain(s, d):
    return graph.citing(*legal_graph(s, d), "a7")


def risk_findings(s, d):
    return graph.risk_findings(*legal_graph(s, d))


def appeal_chain(s, d):
    n = table(s, d, "nation")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("from_id"), F.concat(F.lit("n"), (F.col("n_nationkey") * 3 + 1) % 25).alias("to_id"), F.lit("APPEALS").alias("type"))
    return graph.appeal_chain(edges, "n2", 6)


def latest_cells(s, d):
    return tabular.latest(cells(s, d)).select("row_id", "col_id", "version", "value_json")


def cell_history(s, d):
    return tabular.history_of(cells(s, d)).filter("before <> value_json").select("row_id", "col_id", "version", "before")


def review_grid(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("label"))
    return tabular.grid(cells(s, d), rows, [(0, "a"), (1, "b"), (2, "c")])


def conditional_cells(s, d):
    v = F.col("value_json")
    return tabular.latest(cells(s, d)).select("row_id", "col_id", tabular.condition("equals", v, '"1-URGENT"').alias("eq"), tabular.condition("not_equals", v, '"1-URGENT"').alias("ne"), tabular.condition("matches", v, "^[12]-").alias("re"))


def span_overlaps(s, d):
    return spans.self_overlaps(line_spans(s, d), ["k"], "id").select("k", "id", "id_r")


def span_contains(s, d):
    a = line_spans(s, d)
    return spans.containing_join(a, a, ["k"]).filter("id <> id_r").select("k", "id", "id_r")


def merged_spans(s, d):
    return spans.merge_overlapping(line_spans(s, d), ["k"], "label")


def healed_spans(s, d):
    return spans.heal_adjacent(line_spans(s, d), ["k"], 2)


def greedy_spans(s, d):
    kept = line_spans(s, d).groupBy("k").agg(spans.greedy_nonoverlap(F.collect_list(F.struct("start", "end"))).alias("x"))
    return kept.select("k", F.inline("x"))


def bio_runs(s, d):
    t = lines(s, d).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("string").substr(1, 4).alias("token"), F.when(F.col("l_returnflag") == "N", "O").otherwise(F.concat(F.when(F.col("l_quantity") > 25, "B-").otherwise("I-"), "l_returnflag")).alias("tag"))
    return spans.bio_spans(t, "l_orderkey", "l_linenumber", "token", "tag")


def last_turns(s, d):
    from pyspark.sql import Window

    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(s, d, "conversations").withColumn("k", F.row_number().over(newest)).filter("k <= 2").select("conv_id", "turn", "role")


QUERIES = {f.__name__: f for f in (
    bm25_scores, keyword_top_k, hybrid_search_rrf, filtered_search, hybrid_vector_search, hybrid_filtered_search, hybrid_document_search, memory_hybrid_search, reranked_search, search_objects, vector_top_k, keyset_page, folder_subtree, memories_by_entity, memory_point_in_time, memory_recall, memory_invalidate, memory_upsert, memory_conflicts, memory_forget,
    token_references, party_dossier, obligations_owed, citation_chain, risk_findings, appeal_chain, latest_cells, cell_history, review_grid, conditional_cells, span_overlaps, span_contains, merged_spans, healed_spans, greedy_spans, bio_runs, last_turns,
)}
_kw = f"{BM25_SQL}, kw AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm)"
_stem = f"st AS (SELECT query, doc_id, count(*) AS c FROM (SELECT doc_id, unnest(list_distinct(list_transform(t, lambda w: w[1:3]))) AS stem FROM t) JOIN (SELECT DISTINCT query, term[1:3] AS stem FROM q) USING (stem) GROUP BY ALL), tr AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY c DESC, doc_id)::INT AS rank FROM st)"
_latest = f"{CELL_SQL}, l AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY row_id, col_id ORDER BY version DESC) = 1)"


def _hybrid_sql(allowed: str, k: int, docs: str = "SELECT doc_id, text FROM documents", vectors: str = "SELECT vec_id AS doc_id, embedding FROM embeddings") -> str:
    """Keyword and vector ranks of the allowed ids, fused."""
    return f"""WITH {BM25_SQL.replace("FROM documents)", "FROM docs0)").replace(QUERY_SQL, f"docs0 AS ({docs}), {QUERY_SQL}")}, al(doc_id) AS ({allowed}),
kw AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE doc_id IN (SELECT doc_id FROM al)), v AS ({vectors}),
vs AS (SELECT CASE q.vec_id WHEN 20 THEN 'q1' ELSE 'q2' END AS query, v.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS score FROM v, embeddings q WHERE q.vec_id IN (20, 40) AND v.doc_id IN (SELECT doc_id FROM al)),
vk AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM vs),
f AS (SELECT query, doc_id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM kw WHERE rank <= 50 UNION ALL SELECT * FROM vk WHERE rank <= 50) GROUP BY ALL)
SELECT query, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY f.score DESC, doc_id) <= {k}"""


_graph = "'o' || l_orderkey || '-' || l_linenumber"
ORACLE = {
    "bm25_scores": f"WITH {BM25_SQL} SELECT query, doc_id, round(score, 6) AS score FROM bm",
    "keyword_top_k": f"WITH {_kw} SELECT * FROM kw WHERE rank <= 10",
    "hybrid_search_rrf": f"WITH {_kw}, {_stem}, f AS (SELECT query, doc_id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM kw WHERE rank <= 50 UNION ALL SELECT * FROM tr WHERE rank <= 50) GROUP BY ALL) SELECT query, doc_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 10",
    "filtered_search": f"WITH {BM25_SQL} SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= 50",
    "hybrid_vector_search": _hybrid_sql("SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings", 10),
    "hybrid_filtered_search": _hybrid_sql("SELECT doc_id FROM documents WHERE lang = 'de'", 20),
    "hybrid_document_search": _hybrid_sql("SELECT unnest([3, 20, 41, 77, 110, 150])", 10),
    "memory_hybrid_search": _hybrid_sql(
        f"WITH {MEM_SQL} SELECT id FROM m0 WHERE valid_from <= 60 AND (valid_to IS NULL OR valid_to > 60) AND kind IN ('preference', 'fact')", 10,
        "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations", "SELECT conv_id * 1000 + turn AS doc_id, embedding FROM conversations JOIN embeddings ON vec_id = (conv_id * 1000 + turn) % 499",
    ).replace("SELECT query, doc_id, round", "SELECT query, doc_id AS id, round"),
    "reranked_search": f"WITH {_kw} SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY 1.0::DOUBLE / (1 + abs(length(text) - 900)) DESC, doc_id)::INT AS rank FROM kw JOIN documents USING (doc_id) WHERE kw.rank <= 40 QUALIFY row_number() OVER (PARTITION BY query ORDER BY 1.0::DOUBLE / (1 + abs(length(text) - 900)) DESC, doc_id) <= 5",
    "search_objects": f"WITH {BM25_SQL} SELECT query, doc_id, source, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm JOIN documents USING (doc_id) WHERE source IN ('src1', 'src3', 'src7') QUALIFY rank <= 8",
    "vector_top_k": "WITH p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank, round(score, 5) AS score FROM p QUALIFY rank <= 5",
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "folder_subtree": "WITH p AS (SELECT page_id, lower(regexp_replace(url, '^https?://', '/')) AS p FROM pages) SELECT page_id FROM p WHERE p = '/m.free-bets.example.com' OR starts_with(p, '/m.free-bets.example.com/') OR p = '/blog.ththan.example.net/en' OR starts_with(p, '/blog.ththan.example.net/en/')",
    "memories_by_entity": f"WITH {MEM_SQL} SELECT id, kind FROM m0 WHERE list_has_any(refs, ['the', 'de', 'and']) AND valid_from <= 60 AND (valid_to IS NULL OR valid_to > 60) ORDER BY id LIMIT 100",
    "memory_point_in_time": f"WITH {MEM_SQL} SELECT id, valid_from FROM m0 WHERE valid_from <= 50 AND (valid_to IS NULL OR valid_to > 50) AND (session IS NULL OR session = 's3')",
    "memory_recall": f"WITH {MEM_SQL}, p AS (SELECT *, (id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM m0 ORDER BY score DESC, id LIMIT 400) SELECT id, score FROM p WHERE kind IN ('preference', 'fact') AND (session IS NULL OR session = 's1') AND valid_from <= 30 AND (valid_to IS NULL OR valid_to > 30) ORDER BY score DESC, id LIMIT 200",
    "memory_invalidate": f"WITH {MEM_SQL} SELECT id, coalesce(CASE WHEN id % 7 = 0 AND valid_to IS NULL THEN 99 ELSE valid_to END, -1)::BIGINT AS valid_to FROM m0",
    "memory_upsert": f"WITH {MEM_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE kind END AS kind FROM m0",
    "memory_conflicts": f"WITH {MEM_SQL}, m AS (SELECT m0.*, e.embedding::DOUBLE[] AS v FROM m0 JOIN embeddings e ON vec_id = id % 10 WHERE kind IN ('preference', 'reference')) SELECT a.id, b.id AS prior, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM m a JOIN m b ON a.kind = b.kind AND b.created_at < a.created_at AND b.valid_to IS NULL AND list_has_any(a.refs, b.refs) WHERE list_cosine_similarity(a.v, b.v) >= 0.5",
    "memory_forget": f"WITH {MEM_SQL} SELECT DISTINCT unnest(refs) AS token FROM m0 WHERE id % 2 <> 0",
    "token_references": f"WITH {MEM_SQL} SELECT count_if(list_contains(refs, 'the'))::BIGINT AS n FROM m0",
    "party_dossier": f"WITH {LINES_SQL} SELECT 'c1' AS party_id, 'o' || o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS document_date, {_graph} AS chunk_id FROM orders JOIN li ON l_orderkey = o_orderkey WHERE o_custkey = 1",
    "obligations_owed": f"WITH {LINES_SQL} SELECT 'c1' AS party_id, 'b' || {_graph} AS ob_id, l_returnflag AS kind, CASE WHEN l_linenumber % 2 = 1 THEN {_graph} END AS chunk_id FROM orders JOIN li ON l_orderkey = o_orderkey WHERE o_custkey = 1 AND l_linestatus = 'F'",
    "citation_chain": f"WITH {LINES_SQL} SELECT 'o' || l_orderkey AS doc, {_graph} AS chunk FROM li WHERE l_partkey % 500 = 7",
    "risk_findings": f"WITH {LINES_SQL} SELECT 'o' || l_orderkey AS doc_id, 'r' || {_graph} AS risk_id, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN l_quantity > 40 THEN 0 WHEN l_quantity > 20 THEN 1 ELSE 2 END AS severity_rank FROM li WHERE l_returnflag = 'R'",
    "appeal_chain": "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey * 3 + 1) % 25) AS b FROM nation), c AS (SELECT 'n2' AS id, 0 AS depth, 'n2' AS path UNION ALL SELECT b, depth + 1, path || '>' || b FROM c JOIN e ON a = id WHERE depth < 6) SELECT * FROM c",
    "latest_cells": f"WITH {_latest} SELECT row_id, col_id, version, value_json FROM l",
    "cell_history": f"WITH {CELL_SQL}, h AS (SELECT *, lag(value_json) OVER (PARTITION BY row_id, col_id ORDER BY version) AS before FROM cells) SELECT row_id, col_id, version, before FROM h WHERE before <> value_json",
    "review_grid": f"WITH {_latest} SELECT c_custkey AS row_id, c_name AS label, coalesce(max(value_json) FILTER (col_id = 0), '') AS a, coalesce(max(value_json) FILTER (col_id = 1), '') AS b, coalesce(max(value_json) FILTER (col_id = 2), '') AS c FROM customer LEFT JOIN l ON row_id = c_custkey GROUP BY ALL",
    "conditional_cells": f"WITH {_latest} SELECT row_id, col_id, value_json = '\"1-URGENT\"' AS eq, value_json <> '\"1-URGENT\"' AS ne, regexp_matches(trim(value_json, '\"'), '^[12]-') AS re FROM l",
    "span_overlaps": f"WITH {SPAN_SQL} SELECT a.k, a.id, b.id AS id_r FROM sp a JOIN sp b ON a.k = b.k AND a.s < b.e AND a.e > b.s AND a.id < b.id",
    "span_contains": f"WITH {SPAN_SQL} SELECT a.k, a.id, b.id AS id_r FROM sp a JOIN sp b ON a.k = b.k AND a.id <> b.id AND a.s <= b.s AND a.e >= b.e",
    "merged_spans": f"WITH {SPAN_SQL}, n AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY k ORDER BY s, e DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS f FROM sp), g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s, e DESC, label ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT k, min(s) AS start, max(e) AS \"end\", arg_min(label, (s, -e, label)) AS label FROM g GROUP BY k, g",
    "healed_spans": f"WITH {SPAN_SQL}, n AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY k, label ORDER BY s, e) > 2, true)::INT AS f FROM sp), g AS (SELECT *, sum(f) OVER (PARTITION BY k, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT k, label, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY k, label, g",
    "bio_runs": f"WITH {LINES_SQL}, t AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y') AS token, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS l, l_quantity > 25 AS b FROM li), p AS (SELECT *, lag(l) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM t), g AS (SELECT *, sum((l IS NOT NULL AND (b OR p IS NULL OR p <> l))::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM p) SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber) + 1 AS \"end\", any_value(l) AS label, string_agg(token, ' ' ORDER BY l_linenumber) AS text FROM g WHERE l IS NOT NULL GROUP BY l_orderkey, g",
    "greedy_spans": f"""WITH RECURSIVE {SPAN_SQL}, o AS (SELECT k, id, s, e, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, id) AS r FROM sp),
w AS (SELECT k, 0::BIGINT AS r, -1::BIGINT AS s, -1::BIGINT AS e, -1 AS id, -1::BIGINT AS last FROM (SELECT DISTINCT k FROM sp) UNION ALL SELECT w.k, o.r, o.s, o.e, CASE WHEN o.s >= w.last THEN o.id ELSE -1 END, CASE WHEN o.s >= w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.k = w.k AND o.r = w.r + 1)
SELECT k, s AS start, e AS "end" FROM w WHERE id >= 0""",
    "last_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
}
