"""Queries over stores, registers, citations, imports and exports, made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import coref, extract, memory, scoring, signals, spans, store, subjects, tabular
from textloom.plans.retrieval import CELL_SQL, LINES_SQL, MEM_SQL, cells, legal_graph, lines, memories
from textloom.plans.tables import table
from textloom.sources import exports

CHUNKS_SQL = "ch AS (SELECT page_id AS doc_id, url AS source_path FROM pages)"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_path"))


def folder_deleted(s, d):
    return store.delete_folder(_chunks(s, d), "https://blog.ththan.example.net/en")[0].select("doc_id")


def folder_delete_counts(s, d):
    return store.delete_folder(_chunks(s, d), "https://blog.ththan.example.net/en")[1]


def keys_deleted(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return store.delete_keys(o, table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


def scope_forgotten(s, d):
    objects = table(s, d, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("scope"))
    left = store.forget_scope({"orders": table(s, d, "orders").select(F.col("o_custkey").alias("object_id"), "o_orderkey")}, objects, F.col("scope") == "BUILDING")
    return left["orders"].select("o_orderkey")


def absent_inserted(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return store.insert_if_absent(c.filter("c_custkey % 3 = 0"), c.withColumn("c_name", F.lit("new")), ["c_custkey"])


def corpus_freshness(s, d):
    runs = table(s, d, "events").select(F.col("user_id").alias("corpus_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_id") % 5 == 0, "done").when(F.col("event_id") % 5 == 1, "failed").otherwise("running").alias("status"))
    return store.freshness(runs).select("corpus_id", F.date_format("last_done", "yyyy-MM-dd HH:mm:ss").alias("last_done"), "failed_since")


def job_transitions(s, d):
    jobs = table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return store.transition(jobs, "X", {"O": {"X"}, "P": {"X", "Y"}, "F": {"Y"}}, jobs.filter("job_id % 2 = 0").select("job_id"))


def roots_overlapping(s, d):
    roots = table(s, d, "pages").select(F.col("page_id").alias("corpus_id"), F.col("url").alias("root"))
    return store.overlapping_roots(roots, "https:/").select("corpus_id")


def cells_appended(s, d):
    own = cells(s, d).withColumns({"locked": F.col("row_id") % 3 == 0, "author": F.lit("user")})
    new = own.select("row_id", "col_id").distinct().withColumns({"value_json": F.lit('"z"'), "locked": F.lit(False), "author": F.when(F.col("col_id") == 1, "system").otherwise("user")})
    return tabular.append_version(own, new)[0].filter("value_json = '\"z\"'").select("row_id", "col_id", "version")


def cells_refused(s, d):
    own = cells(s, d).withColumns({"locked": F.col("row_id") % 3 == 0, "author": F.lit("user")})
    new = own.select("row_id", "col_id").distinct().withColumns({"value_json": F.lit('"z"'), "locked": F.lit(False), "author": F.when(F.col("col_id") == 1, "system").otherwise("user")})
    return tabular.append_version(own, new)[1].select("row_id", "col_id")


def review_markdown(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("label"))
    return tabular.markdown(tabular.grid(cells(s, d), rows, [(0, "a"), (1, "b")]), "label", ["a", "b"]).select("line")


def citations_verified(s, d):
    p = table(s, d, "part")
    chunks = p.filter("p_partkey % 9 > 0").select(F.col("p_partkey").alias("chunk_id"), F.concat("p_name", F.lit(" é"), "p_type").alias("text"))
    start, end = F.col("p_partkey") % 30, F.col("p_partkey") % 30 + F.col("p_size") % 9 - 1
    quote = F.substring(F.concat("p_name", F.lit(" é"), "p_type"), start + 1, end - start)
    cited = p.select(F.col("p_partkey").alias("chunk_id"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.when(F.col("p_partkey") % 4 == 0, "other").otherwise(quote).alias("quote"))
    return tabular.verify_citations(cited, chunks).select("chunk_id", "outcome")


def entities_validated(s, d):
    t = table(s, d, "documents").filter("text is not null")
    at = F.col("doc_id") % 7
    made = t.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "wrong").otherwise(F.substring("text", at.cast("int") + 1, F.lit(4))).alias("text"), at.cast("int").alias("start"), F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 13 == 0, 1 << 20).otherwise(at + 4).cast("int").alias("end"), (F.col("doc_id") % 10 / 8).alias("confidence"))
    return signals.validate_entities(made, t.filter("doc_id % 17 > 0")).select("doc_id", F.array_join("issues", ",").alias("issues"))


def labels_mapped(s, d):
    p = table(s, d, "part").select("p_partkey", F.element_at(F.split("p_type", " "), 1).alias("label"))
    return signals.map_labels(p, {"STANDARD": "PLAIN", "SMALL": "PLAIN", "PROMO": "SALE"}).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def references_dangling(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    signal = o.filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("signal_id"))
    tracks = c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("track_id"), (F.col("c_custkey") % 40).alias("identity_id"))
    links = o.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("signal_id"))
    return signals.dangling(signal, tracks, links, s.range(30).withColumnRenamed("id", "identity_id"))


def relations_nearby(s, d):
    t = table(s, d, "documents").filter("length(text) > 60").select("doc_id", "text")
    entities = t.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(a + 5).alias("end")) for a in (0, 12, 30, 50)))).alias("idx", "x")).select("doc_id", "idx", "x.*")
    return extract.relation_pairs(t, entities, gap=20).select("doc_id", "head_idx", "tail_idx", "relation")


def ranked_retrieval_scores(s, d):
    li = lines(s, d)
    hits = li.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("d"), F.col("l_linenumber")).alias("doc"), (F.col("l_linenumber") - 1).alias("rank"))
    qrels = li.filter("l_partkey % 3 > 0").select(F.col("l_orderkey").alias("query"), F.concat(F.lit("d"), F.col("l_linenumber")).alias("doc"), (F.col("l_partkey") % 3).cast("int").alias("grade"))
    got = scoring.retrieval_scores(hits, qrels, 3)
    return got.select("query", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def memory_graph_recall(s, d):
    return memory.graph_recall(memories(s, d), ["the"], F.lit(60), 1, 1 << 20).select("entity", "hop", "mentions")


def memory_deleted(s, d):
    m = memories(s, d)
    return memory.forget(m, m.select(F.explode("entity_refs").alias("token")).distinct(), m.filter("id % 3 = 0").select("id"))[0].select("id")


def entity_chains(s, d):
    li = lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ent_idx"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_returnflag")).alias("canonical_id"), (F.col("l_linenumber") * 9).alias("start"), F.col("l_linestatus").alias("text"))
    return coref.chains_of_entities(li)


def cross_document_b_cubed(s, d):
    li = lines(s, d)
    side = lambda name, chain, k: li.filter(F.col("l_partkey") % k > 0).select(F.lit(name).alias("side"), F.col("l_orderkey").alias("doc_id"), F.col(chain).alias("chain_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    got = coref.cross_document_b_cubed(side("gold", "l_returnflag", 5).unionByName(side("pred", "l_linestatus", 7)))
    return got.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def graph_csv_nodes(s, d):
    return exports.graph_csv(*legal_graph(s, d))[0].groupBy(":LABEL").agg(F.count(F.lit(1)).alias("n"))


def graph_csv_edges(s, d):
    return exports.graph_csv(*legal_graph(s, d))[1].groupBy(":TYPE").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(":START_ID").alias("starts"))


def jsonl_export(s, d):
    return exports.jsonl(table(s, d, "nation").select("n_nationkey", "n_name"))


def span_gold_pairs(s, d):
    li = lines(s, d)
    a = li.filter("l_partkey % 3 > 0").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.col("l_returnflag").alias("label"))
    b = li.filter("l_partkey % 4 > 0").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_partkey") % 2 + 1).alias("end"), F.col("l_linestatus").alias("label"))
    return spans.overlap_join(a, b, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"))


def span_errors(s, d):
    li, at = lines(s, d), F.col("l_linenumber") * 10
    gold = li.filter("l_partkey % 6 > 0").select("l_orderkey", at.alias("start"), (at + 6).alias("end"), F.col("l_returnflag").alias("label"))
    shift = F.col("l_partkey") % 4
    pred = li.filter("l_partkey % 7 > 0").select("l_orderkey", (at + shift).cast("int").alias("start"), (at + shift + 6).cast("int").alias("end"), F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise("N").alias("label"))
    return spans.error_analysis(gold, pred, "l_orderkey").groupBy("category", "gold_label", "label").agg(F.count(F.lit(1)).alias("n"))


def _vault(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select(F.concat(F.lit("T_"), "c_custkey").alias("token"), F.element_at(F.array(*map(F.lit, ("person", "email", "iban"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("category"), F.col("c_name").alias("original"))


def subject_found(s, d):
    return subjects.find_subject(_vault(s, d), " CUSTOMER#00000001")


def subject_exported(s, d):
    return subjects.export_subject(subjects.find_subject(_vault(s, d), "customer#00000000"))


def vault_categories(s, d):
    return subjects.vault_stats(_vault(s, d))


def personal_entities(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "pattern").otherwise("model").alias("source"), F.element_at(F.array(*map(F.lit, ("PERSON", "place", "Secret", "org"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("category"))
    return p.filter(subjects.is_personal(F.col("source"), F.col("category"), ["secret"])).select("p_partkey")


def folders_indexed(s, d):
    return subjects.indexed_folders(_chunks(s, d).select(F.regexp_replace("source_path", "/[^/]*$", "").alias("folder_path")))


def chunks_counted(s, d):
    return subjects.chunk_count(_chunks(s, d))


def _objects(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, o = table(s, d, "customer"), table(s, d, "orders")
    objects = c.select(F.col("c_custkey").alias("object_id"), (F.col("c_custkey") % 4).cast("int").alias("revision"), F.col("c_name").alias("title"))
    parts = o.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("part"))
    new = objects.filter("object_id % 5 = 0").withColumn("title", F.lit("new")).unionByName(s.createDataFrame([(10**9, 0, "added")], objects.schema))
    return objects, parts, new, parts.filter("part % 2 = 0")


def objects_committed(s, d):
    return subjects.commit_objects(*_objects(s, d))[0]


def parts_committed(s, d):
    return subjects.commit_objects(*_objects(s, d))[1]


def revisions_ready(s, d):
    objects = _objects(s, d)[0].select("object_id", "revision")
    indexed = objects.filter("object_id % 3 = 0").select("object_id", "revision", F.when(F.col("object_id") % 2 == 0, "v1").otherwise("v2").alias("provider_version"))
    return subjects.revision_ready(objects, indexed, "v1")


def risks_merged(s, d):
    risk = lambda by, keep, severity: F.when(keep, F.struct(F.lit(by).alias("by"), F.lit(severity).alias("severity")))
    risks = F.array(risk("rule", F.col("l_quantity") > 30, "high"), risk("model", F.col("l_partkey") % 2 == 0, "low"))
    rows = lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category"), F.explode(risks).alias("x"))  # the shuffle of the lines is shared
    of = lambda by: rows.filter(F.col("x.by") == by).select("doc_id", "category", "x.severity")
    return subjects.merge_risks(of("rule"), of("model")).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


def _review_columns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(s, d, "nation")
    return n.select(F.col("n_regionkey").alias("review_id"), F.col("n_nationkey").alias("col_id"), F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_regionkey").alias("review_id"), F.lit(3).alias("schema_version"))


def column_added(s, d):
    return subjects.add_column(*_review_columns(s, d), 2, "NEW")[0]


def schema_bumped(s, d):
    return subjects.add_column(*_review_columns(s, d), 2, "NEW")[1]


QUERIES = {f.__name__: f for f in (
    folder_deleted, folder_delete_counts, keys_deleted, scope_forgotten, absent_inserted, corpus_freshness, job_transitions, roots_overlapping, cells_appended, cells_refused, review_markdown, citations_verified, entities_validated, labels_mapped, references_dangling, relations_nearby,
    ranked_retrieval_scores, memory_graph_recall, memory_deleted, entity_chains, cross_document_b_cubed, graph_csv_nodes, graph_csv_edges, jsonl_export, span_gold_pairs, span_errors, subject_found, subject_exported, vault_categories, personal_entities, folders_indexed, chunks_counted,
    objects_committed, parts_committed, revisions_ready, risks_merged, column_added, schema_bumped,
)}

_inside = "(lower(source_path) = 'https://blog.ththan.example.net/en' OR starts_with(lower(source_path), 'https://blog.ththan.example.net/en/'))"
_live = f"{MEM_SQL}, lv AS (SELECT id, refs FROM m0 WHERE valid_from <= 60 AND (valid_to IS NULL OR valid_to > 60))"
_fed = f"{CELL_SQL}, nx AS (SELECT row_id, col_id, max(version) + 1 AS version FROM cells GROUP BY ALL)"
_vault_sql = "v AS (SELECT 'T_' || c_custkey AS token, ['person', 'email', 'iban'][c_custkey % 3 + 1] AS category, c_name AS original FROM customer)"
_cut = "substr(t, s + 1, e - s)"
ORACLE = {
    "folder_deleted": f"WITH {CHUNKS_SQL} SELECT doc_id FROM ch WHERE NOT {_inside}",
    "folder_delete_counts": f'WITH {CHUNKS_SQL} SELECT count(*) AS "rows", count(DISTINCT doc_id) AS documents, count(DISTINCT source_path) AS paths FROM ch WHERE {_inside}',
    "keys_deleted": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "scope_forgotten": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "absent_inserted": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new' END AS c_name FROM customer",
    "corpus_freshness": "WITH r AS (SELECT user_id AS corpus_id, ts, event_id % 5 AS k, max(CASE WHEN event_id % 5 = 0 THEN ts END) OVER (PARTITION BY user_id) AS l FROM events) SELECT corpus_id, strftime(any_value(l), '%Y-%m-%d %H:%M:%S') AS last_done, count_if(k = 1 AND (l IS NULL OR ts > l))::BIGINT AS failed_since FROM r GROUP BY 1",
    "job_transitions": "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O', 'P') THEN 'X' ELSE o_orderstatus END AS status FROM orders",
    "roots_overlapping": "SELECT page_id AS corpus_id FROM pages WHERE regexp_replace(lower(url), '/+$', '') = 'https:' OR starts_with(lower(url), 'https:/') OR starts_with('https:', regexp_replace(lower(url), '/+$', '') || '/')",
    "cells_appended": f"WITH {_fed} SELECT row_id, col_id, version FROM nx WHERE NOT (row_id % 3 = 0 AND col_id = 1)",
    "cells_refused": f"WITH {_fed} SELECT row_id, col_id FROM nx WHERE row_id % 3 = 0 AND col_id = 1",
    "review_markdown": f"WITH {CELL_SQL}, l AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY row_id, col_id ORDER BY version DESC) = 1) SELECT '| ' || c_name || ' | ' || coalesce(max(value_json) FILTER (col_id = 0), '') || ' | ' || coalesce(max(value_json) FILTER (col_id = 1), '') || ' |' AS line FROM customer LEFT JOIN l ON row_id = c_custkey GROUP BY c_custkey, c_name",
    "citations_verified": f"""WITH c AS (SELECT p_partkey AS chunk_id, p_name || ' é' || p_type AS t, p_partkey % 30 AS s, p_partkey % 30 + p_size % 9 - 1 AS e, length(p_name) + 2 AS q FROM part)
SELECT chunk_id, CASE WHEN chunk_id % 9 = 0 THEN 'unknown_chunk' WHEN s > e THEN 'inverted' WHEN e > strlen(t) THEN 'out_of_bounds' WHEN s = q OR e = q THEN 'split_character'
WHEN chunk_id % 4 = 0 THEN CASE WHEN e = s THEN 'mismatch' ELSE 'mismatch' END WHEN array_slice(encode(t), s + 1, e) <> encode({_cut}) THEN 'mismatch' ELSE 'ok' END AS outcome FROM c""",
    "entities_validated": """WITH e AS (SELECT doc_id, text AS t, doc_id % 7 AS s, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 1048576 ELSE doc_id % 7 + 4 END AS e, CASE WHEN doc_id % 5 = 0 THEN 'wrong' ELSE substr(text, doc_id % 7 + 1, 4) END AS x, doc_id % 10 / 8 AS c, doc_id % 17 > 0 AS known FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT known THEN 'no document' END, CASE WHEN trim(x) = '' THEN 'empty text' END, CASE WHEN s >= e THEN 'inverted span' END, CASE WHEN known AND e > length(t) THEN 'out of bounds' END,
CASE WHEN known AND s < e AND e <= length(t) AND substr(t, s + 1, e - s) <> x THEN 'text mismatch' END, CASE WHEN c > 1 THEN 'confidence' END], lambda y: y IS NOT NULL), ',') AS issues FROM e""",
    "labels_mapped": "WITH p AS (SELECT string_split(p_type, ' ')[1] AS l FROM part) SELECT CASE l WHEN 'STANDARD' THEN 'PLAIN' WHEN 'SMALL' THEN 'PLAIN' WHEN 'PROMO' THEN 'SALE' ELSE l END AS type, count(*) AS n FROM p GROUP BY 1",
    "references_dangling": "SELECT 'signal' AS kind, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'track', o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0) UNION ALL SELECT 'identity', (c_custkey % 40)::VARCHAR FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 40 >= 30",
    "relations_nearby": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 60), e(i, s) AS (VALUES (0, 0), (1, 12), (2, 30), (3, 50)), p AS (SELECT doc_id, a.i AS h, b.i AS t, lower(substr(text, a.s + 6, b.s - a.s - 5)) AS w FROM d, e a, e b WHERE a.i < b.i AND b.s - a.s - 5 BETWEEN 0 AND 20)
SELECT doc_id, h AS head_idx, t AS tail_idx, CASE WHEN regexp_matches(w, 'found(?:ed|er)') THEN 'FOUNDED' WHEN regexp_matches(w, 'works (?:for|at)|employ') THEN 'WORKS_FOR' WHEN regexp_matches(w, 'located|based in|\\bin\\b') THEN 'LOCATED_IN' WHEN regexp_matches(w, 'married|wife|husband') THEN 'MARRIED_TO' WHEN regexp_matches(w, 'acquir|bought') THEN 'ACQUIRED' ELSE 'UNKNOWN' END AS relation FROM p""",
    "ranked_retrieval_scores": f"""WITH {LINES_SQL}, q AS (SELECT l_orderkey AS query, l_linenumber AS n, l_partkey % 3 AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 3 DESC, l_linenumber) AS k FROM li WHERE l_partkey % 3 > 0)
SELECT query, round(count_if(n <= 3) / count(*), 6) AS recall, round(sum(CASE WHEN n <= 3 THEN (2.0 ** g - 1) / log2(n + 1) ELSE 0.0 END) / sum(CASE WHEN k <= 3 THEN (2.0 ** g - 1) / log2(k + 1) ELSE 0.0 END), 6) AS ndcg FROM q GROUP BY 1""",
    "memory_graph_recall": f"WITH {_live}, h AS (SELECT DISTINCT unnest(refs) AS entity FROM lv WHERE list_contains(refs, 'the')), c AS (SELECT e AS entity, count(*) AS n FROM (SELECT unnest(refs) AS e FROM lv) GROUP BY 1), x AS (SELECT 'the' AS entity, 0 AS hop UNION ALL SELECT entity, 1 FROM h WHERE entity <> 'the') SELECT entity, hop, coalesce(n, 0) AS mentions FROM x LEFT JOIN c USING (entity)",
    "memory_deleted": f"WITH {MEM_SQL} SELECT id FROM m0 WHERE id % 3 <> 0",
    "entity_chains": f"WITH {LINES_SQL}, e AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 4 > 0 THEN 'c' || l_returnflag ELSE 'e' || l_linenumber END AS chain, l_linenumber * 9 AS s, lower(l_linestatus) AS t FROM li) SELECT doc_id, chain, count(*) AS size, min(s) AS \"first\", max(s) - min(s) AS spread, count(DISTINCT t) AS variants FROM e GROUP BY ALL",
    "cross_document_b_cubed": f"""WITH {LINES_SQL}, b AS (SELECT CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS g, CASE WHEN l_partkey % 7 > 0 THEN l_linestatus END AS p FROM li WHERE l_partkey % 5 > 0 OR l_partkey % 7 > 0),
c AS (SELECT g, p, count(*) AS n FROM b WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n * n / (SELECT count(*) FROM b WHERE b.p = c.p)) / (SELECT count(*) FROM b) AS p, sum(n * n / (SELECT count(*) FROM b WHERE b.g = c.g)) / (SELECT count(*) FROM b) AS r FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
    "graph_csv_nodes": f"""WITH {LINES_SQL} SELECT * FROM (SELECT 'Document' AS ":LABEL", count(*) AS n FROM orders UNION ALL SELECT 'Party', count(*) FROM customer UNION ALL SELECT 'Chunk', count(*) FROM li UNION ALL SELECT 'Risk', count(*) FROM li WHERE l_returnflag = 'R' UNION ALL SELECT 'Obligation', count(*) FROM li WHERE l_linestatus = 'F')""",
    "graph_csv_edges": f"""WITH {LINES_SQL}, f AS (SELECT * FROM li WHERE l_linestatus = 'F'), bd AS (SELECT * FROM f JOIN orders ON l_orderkey = o_orderkey), mn AS (SELECT l_orderkey || '-' || l_linenumber AS c FROM f WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey || '-' || l_linenumber FROM li)
SELECT * FROM (SELECT 'PARTY_TO' AS ":TYPE", count(*) AS n, count(DISTINCT o_custkey) AS starts FROM orders UNION ALL SELECT 'HAS_CHUNK', count(*), count(DISTINCT l_orderkey) FROM li UNION ALL SELECT 'HAS_RISK', count(*), count(DISTINCT l_orderkey) FROM li WHERE l_returnflag = 'R'
UNION ALL SELECT 'BOUND_BY', count(*), count(DISTINCT o_custkey) FROM bd UNION ALL SELECT 'MENTIONS', count(*), count(DISTINCT c) FROM mn UNION ALL SELECT 'REFERENCES', count(*), count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_partkey % 500 FROM li))""",
    "jsonl_export": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation",
    "span_gold_pairs": f"WITH {LINES_SQL}, a AS (SELECT l_orderkey, l_linenumber AS s, l_linenumber + 1 AS e FROM li WHERE l_partkey % 3 > 0), b AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber + l_partkey % 2 + 1 AS e FROM li WHERE l_partkey % 4 > 0) SELECT l_orderkey, count(*) AS pairs FROM a JOIN b ON l_orderkey = k AND a.s < b.e AND a.e > b.s GROUP BY 1",
    "span_errors": f"""WITH {LINES_SQL}, x AS (SELECT l_partkey % 6 > 0 AS g, l_partkey % 7 > 0 AS p, l_partkey % 4 AS k, l_returnflag AS a, CASE WHEN l_quantity > 20 THEN l_returnflag ELSE 'N' END AS b FROM li), m AS (SELECT *, g AND p AND k < 2 AS met FROM x),
r AS (SELECT CASE WHEN k = 0 AND a = b THEN 'correct' WHEN k = 0 THEN 'type' WHEN a = b THEN 'boundary' ELSE 'partial' END AS category, a AS gold_label, b AS label FROM m WHERE met UNION ALL SELECT 'false_negative', a, NULL FROM m WHERE g AND NOT met UNION ALL SELECT 'false_positive', NULL, b FROM m WHERE p AND NOT met)
SELECT category, gold_label, label, count(*) AS n FROM r GROUP BY ALL""",
    "subject_found": f"WITH {_vault_sql} SELECT * FROM v WHERE contains(lower(original), 'customer#00000001')",
    "subject_exported": f"""WITH {_vault_sql} SELECT '{{"category":"' || category || '","original":"' || original || '","token":"' || token || '"}}' AS line FROM v WHERE contains(lower(original), 'customer#00000000')""",
    "vault_categories": f"WITH {_vault_sql} SELECT category, count(*) AS entries FROM v GROUP BY 1",
    "personal_entities": "SELECT p_partkey FROM part WHERE p_size > 40 OR p_partkey % 4 IN (0, 2)",
    "folders_indexed": "SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS folder_path FROM pages WHERE url IS NOT NULL",
    "chunks_counted": "SELECT count(*) AS chunks FROM pages",
    "objects_committed": "SELECT c_custkey AS object_id, (c_custkey % 4 + (c_custkey % 5 = 0)::INT)::INT AS revision, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS title FROM customer UNION ALL SELECT 1000000000, 1, 'added'",
    "parts_committed": "SELECT o_custkey AS object_id, o_orderkey AS part FROM orders WHERE NOT (o_custkey % 5 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) OR o_orderkey % 2 = 0",
    "revisions_ready": "SELECT c_custkey AS object_id, (c_custkey % 4)::INT AS revision, c_custkey % 6 = 0 AS ready FROM customer",
    "risks_merged": f"WITH {LINES_SQL}, a AS (SELECT l_orderkey AS d, l_returnflag AS c FROM li WHERE l_quantity > 30), b AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS c FROM li WHERE l_partkey % 2 = 0) SELECT 'rule' AS source, c AS category, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'model', c, count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 2",
    "column_added": "SELECT n_regionkey AS review_id, n_nationkey AS col_id, n_name AS name FROM nation UNION ALL SELECT 2, max(n_nationkey) + 1, 'NEW' FROM nation WHERE n_regionkey = 2",
    "schema_bumped": "SELECT r_regionkey AS review_id, (3 + (r_regionkey = 2)::INT)::INT AS schema_version FROM region",
}
