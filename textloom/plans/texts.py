"""Queries over documents, conversations, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chunks, coref, pii, sampling
from textloom.plans.retrieval import LINES_SQL, lines
from textloom.plans.tables import table
from textloom.sources import exports
from textloom.streaming import buffers

MENTION_SQL = f"""{LINES_SQL}, mn AS (SELECT l_orderkey AS d, l_linenumber AS s, CASE WHEN l_linenumber % 5 > 0 THEN l_partkey % 3 END AS g, CASE WHEN l_linenumber % 6 > 0 THEN (l_quantity > 25)::INT END AS p FROM li),
cm AS (SELECT d, g, p, count(*) AS n FROM mn WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""


def mentions(s: SparkSession, d: str) -> DataFrame:
    side = lambda name, keep, chain: F.when(keep, F.struct(F.lit(name).alias("side"), chain.cast("int").alias("chain_id")))
    sides = F.array(side("gold", F.col("l_linenumber") % 5 > 0, F.col("l_partkey") % 3), side("pred", F.col("l_linenumber") % 6 > 0, F.col("l_quantity") > 25))
    rows = lines(s, d).select("l_orderkey", "l_linenumber", F.explode(sides).alias("x")).filter("x is not null")
    return rows.select("x.side", F.col("l_orderkey").alias("doc_id"), "x.chain_id", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))


def _r(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


def coref_muc(s, d):
    return _r(coref.muc(mentions(s, d)))


def coref_b_cubed(s, d):
    return _r(coref.b_cubed(mentions(s, d)))


def coref_lea(s, d):
    return _r(coref.lea(mentions(s, d)))


def coref_blanc(s, d):
    return _r(coref.blanc(mentions(s, d)))


def coref_purity(s, d):
    return _r(coref.purity(mentions(s, d)))


def coref_ceaf(s, d):
    return _r(coref.ceaf(mentions(s, d)))


def coref_conll(s, d):
    return _r(coref.conll(mentions(s, d)))


def pii_scan(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(pii.scan(F.col("text"))).alias("x")).select("doc_id", "x.*")


def pii_report(s, d):
    return pii.report(pii_scan(s, d))


def pii_redact(s, d):
    t = table(s, d, "documents").select("doc_id", "text").withColumn("spans", pii.scan(F.col("text")))
    return t.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("text"))


def pii_mask(s, d):
    t = table(s, d, "documents").select("doc_id", "text").withColumn("spans", pii.scan(F.col("text")))
    return t.select("doc_id", F.length("text").alias("before"), F.length(pii.mask(F.col("text"), F.col("spans"))).alias("after"))


def document_chunks(s, d):
    return chunks.chunk_ids(chunks.chunk(table(s, d, "documents"), 800, 80)).drop("text")


def content_ids(s, d):
    return chunks.content_ids(table(s, d, "documents")).select("doc_id", "content_id")


def mention_candidates(s, d):
    return chunks.candidate_pairs(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))).select("a", "b", F.round("similarity", 6).alias("similarity"))


def n_triples_export(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("text"), F.col("c_nationkey").alias("doc_id"))
    return exports.n_triples(c)


def brat_export(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", (F.instr("text", "é") - 1).alias("start"), F.lit("MARK").alias("label"), F.lit(0.5).alias("confidence")).filter("start >= 0").withColumn("end", F.col("start") + 1)
    return exports.brat(docs, spans)


def audit_chain(s, d):
    return exports.audit_chain(table(s, d, "events").select("event_id", "ts", "event_type")).select("event_id", "this_hash")


def stream_buffers(s, d):
    words = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("t"), F.posexplode(F.split("text", "(?<= )")).alias("k", "fragment"))
    return buffers.buffered_batch(words.select("stream_id", (F.col("t") * 100_000 + F.col("k")).alias("seq"), "fragment"))


def event_windows(s, d):
    return table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def json_properties(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def hash_sample(s, d):
    return sampling.hash_sample(table(s, d, "documents").select("doc_id", "lang"), ["doc_id"], 100, 7)


def stratified_sample(s, d):
    return sampling.stratified_sample(table(s, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 100, 7)


def annotation_order(s, d):
    return sampling.annotation_order(table(s, d, "lineitem"), "l_orderkey", "l_discount").select("l_orderkey", F.round("priority", 6).alias("priority"))


def html_highlight(s, d):
    docs = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    spans = docs.filter(F.length("text") > 9).select("doc_id", F.lit(2).alias("start"), F.lit(6).alias("end"), F.lit("W").alias("label"))
    return exports.html(docs, spans)


def discourse_transitions(s, d):
    """Share of words that neighbouring turns have in common, and whether the speaker changed."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    words = F.array_distinct(F.split(F.lower("text"), " "))
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", words.alias("w")).withColumns({"before": F.lag("w").over(order), "last": F.lag("role").over(order)})
    return rows.filter("before is not null").select("conv_id", "turn", F.round(F.size(F.array_intersect("w", "before")) / F.size(F.array_union("w", "before")), 6).alias("shared"), (F.col("role") != F.col("last")).alias("changed"))


QUERIES = {f.__name__: f for f in (
    coref_muc, coref_b_cubed, coref_lea, coref_blanc, coref_purity, coref_ceaf, coref_conll, pii_scan, pii_report, pii_redact, pii_mask, document_chunks, content_ids, mention_candidates, n_triples_export, brat_export,
    audit_chain, stream_buffers, event_windows, json_properties, hash_sample, stratified_sample, annotation_order, html_highlight, discourse_transitions,
)}
_prf = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"
_p2 = "({0} * ({0} - 1) / 2)"
ORACLE = {
    "coref_muc": f"WITH {MENTION_SQL}, a AS (SELECT sum(n - k) / sum(n - 1) AS p FROM (SELECT sum(n) AS n, count(*) AS k FROM cm GROUP BY d, p)), b AS (SELECT sum(n - k) / sum(n - 1) AS r FROM (SELECT sum(n) AS n, count(*) AS k FROM cm GROUP BY d, g)) SELECT {_prf} FROM a, b",
    "coref_b_cubed": f"WITH {MENTION_SQL}, gs AS (SELECT d, g, count(*) AS gn FROM mn WHERE g IS NOT NULL GROUP BY ALL), ps AS (SELECT d, p, count(*) AS pn FROM mn WHERE p IS NOT NULL GROUP BY ALL), x AS (SELECT sum(n * n / pn) / sum(n) AS p, sum(n * n / gn) / sum(n) AS r FROM cm JOIN gs USING (d, g) JOIN ps USING (d, p)) SELECT {_prf} FROM x",
    "coref_lea": f"WITH {MENTION_SQL}, gs AS (SELECT d, g, sum(n) AS gn FROM cm GROUP BY ALL), ps AS (SELECT d, p, sum(n) AS pn FROM cm GROUP BY ALL), a AS (SELECT d, p, sum(n) AS size, sum({_p2.format('n')}) AS l, max(gn = 1) AS alone FROM cm JOIN gs USING (d, g) GROUP BY ALL), b AS (SELECT d, g, sum(n) AS size, sum({_p2.format('n')}) AS l, max(pn = 1) AS alone FROM cm JOIN ps USING (d, p) GROUP BY ALL), x AS (SELECT (SELECT sum(size * CASE WHEN size = 1 THEN alone::INT ELSE l / {_p2.format('size')} END) / sum(size) FROM a) AS p, (SELECT sum(size * CASE WHEN size = 1 THEN alone::INT ELSE l / {_p2.format('size')} END) / sum(size) FROM b) AS r) SELECT {_prf} FROM x",
    "coref_blanc": f"WITH {MENTION_SQL}, x AS (SELECT (SELECT sum({_p2.format('n')}) FROM cm) AS cc, (SELECT sum({_p2.format('n')}) FROM (SELECT sum(n) AS n FROM cm GROUP BY d, g)) AS g, (SELECT sum({_p2.format('n')}) FROM (SELECT sum(n) AS n FROM cm GROUP BY d, p)) AS p, (SELECT sum({_p2.format('n')}) FROM (SELECT sum(n) AS n FROM cm GROUP BY d)) AS a), y AS (SELECT cc / p AS p1, cc / g AS r1, (a - p - g + cc) / (a - p) AS p2, (a - p - g + cc) / (a - g) AS r2 FROM x) SELECT round((p1 + p2) / 2, 6) AS precision, round((r1 + r2) / 2, 6) AS recall, round((2 * p1 * r1 / (p1 + r1) + 2 * p2 * r2 / (p2 + r2)) / 2, 6) AS f1 FROM y",
    "coref_purity": f"WITH {MENTION_SQL} SELECT (SELECT round(sum(m) / sum(n), 6) FROM (SELECT max(n) AS m, sum(n) AS n FROM cm GROUP BY d, p)) AS purity, (SELECT round(sum(m) / sum(n), 6) FROM (SELECT max(n) AS m, sum(n) AS n FROM cm GROUP BY d, g)) AS completeness",
    "content_ids": "SELECT doc_id, sha256(text) AS content_id FROM documents",
    "n_triples_export": """WITH e AS (SELECT '<urn:textloom:entity:' || c_custkey || '> ' AS me, * FROM customer)
SELECT me || '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:textloom:type:' || c_mktsegment || '> .' AS line FROM e UNION ALL SELECT me || '<http://www.w3.org/2000/01/rdf-schema#label> "' || c_name || '" .' FROM e UNION ALL SELECT me || '<urn:textloom:in> <urn:textloom:doc:' || c_nationkey || '> .' FROM e""",
    "brat_export": "WITH m AS (SELECT doc_id, instr(text, 'é') - 1 AS s, text FROM documents WHERE instr(text, 'é') > 0), b AS (SELECT doc_id, strlen(substr(text, 1, s)) AS a FROM m) SELECT doc_id, 'T1' || chr(9) || 'MARK ' || a || ' ' || (a + 2) || chr(9) || 'é' AS line FROM b UNION ALL SELECT doc_id, 'A1' || chr(9) || 'Confidence T1 0.50' FROM b",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "json_properties": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "annotation_order": "SELECT l_orderkey, round(max(1 - l_discount), 6) AS priority FROM lineitem GROUP BY 1",
    "html_highlight": """WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), e AS (SELECT doc_id, length(text) AS n, replace(replace(replace(substr(text, 1, 2), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS a, replace(replace(replace(substr(text, 3, 4), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS b, replace(replace(replace(substr(text, 7), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS c, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS w FROM t)
SELECT doc_id, CASE WHEN n > 9 THEN a || '<mark class="W">' || b || '</mark>' || c ELSE w END AS line FROM e""",
    "discourse_transitions": "WITH w AS (SELECT conv_id, turn, role, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations), l AS (SELECT *, lag(w) OVER o AS b, lag(role) OVER o AS r FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, round(len(list_intersect(w, b)) / len(list_distinct(w || b)), 6) AS shared, role <> r AS changed FROM l WHERE b IS NOT NULL",
}
