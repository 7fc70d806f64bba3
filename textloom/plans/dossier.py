"""Queries over case files and contracts made of orders: a customer's orders are a dossier, their lines chunks that mention events and obligations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import dossier, graph
from textloom.plans.retrieval import LINES_SQL, lines
from textloom.plans.tables import table
from textloom.storage import stash


#: Columns of the lines that chunks and their events, or their obligations, are made of.
EVENTS, DUTIES = ("l_returnflag", "l_linestatus", "l_shipdate"), ("l_returnflag", "l_linestatus", "l_quantity", "l_partkey")


def case_graph(s: SparkSession, d: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. The lines are written once with the columns to keep: a walk over chunks reads them for four kinds of nodes and edges, and would deal and group them for each. What needs other columns reads the table."""
    o, full = table(s, d, "orders"), lines(s, d)
    li = stash(full.select("l_orderkey", "l_linenumber", *keep), "lines") if keep else full
    having = lambda *columns: li if {*columns} <= {*keep} else full
    doc, chunk = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber")
    owner, null, none = F.concat(F.lit("o"), "l_orderkey"), F.lit(None).cast("string"), F.lit("{}")
    node = lambda df, label, key, of, props: df.select(F.lit(label).alias("label"), key.alias("id"), of.alias("doc_id"), props.alias("props"))
    edge = lambda df, a, b, kind, of, props=none: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), of.alias("doc_id"), props.alias("props"))
    kind = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))  # no type for the least
    document = F.to_json(F.struct(F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("d"), "o_custkey")).alias("dossier_id"), kind.alias("doc_type")))
    shipped = lambda *columns: having("l_linestatus", *columns).filter("l_linestatus = 'F'")
    returned = lambda *columns: having("l_returnflag", *columns).filter("l_returnflag = 'R'")
    event = F.to_json(F.struct(F.col("l_returnflag").alias("kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("event_date"), F.when(F.col("l_linenumber") < 4, F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd")).alias("deadline_date")))
    duty = F.to_json(F.struct(F.when(F.col("l_quantity") > 10, F.lit("pay")).alias("kind"), F.concat(F.lit("part "), "l_partkey").alias("text_pseudo")))
    severity = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "moyen").otherwise("low")
    e, b, r, c = F.concat(F.lit("e"), chunk), F.concat(F.lit("b"), chunk), F.concat(F.lit("r"), chunk), F.concat(F.lit("c"), "o_custkey")
    nodes = [node(o, "Document", doc, doc, document), node(li, "Chunk", chunk, owner, none), node(shipped("l_returnflag", "l_shipdate"), "Event", e, owner, event), node(returned("l_quantity", "l_partkey"), "Obligation", b, owner, duty), node(returned("l_quantity"), "Risk", r, owner, F.to_json(F.struct(severity.alias("severity"))))]
    nodes.append(node(table(s, d, "customer"), "Party", F.concat(F.lit("c"), "c_custkey"), null, F.to_json(F.struct(F.col("c_name").alias("canonical_name")))))
    role = F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("role")))
    edges = [edge(o, c, doc, "PARTY_TO", doc, role), edge(li, owner, chunk, "HAS_CHUNK", owner), edge(shipped(), chunk, e, "MENTIONS", owner), edge(returned(), chunk, b, "MENTIONS", owner), edge(returned(), owner, r, "HAS_RISK", owner)]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def case_file_documents(s, d):
    return dossier.documents(case_graph(s, d)[0])


def procedural_timeline(s, d):
    return dossier.timeline(*case_graph(s, d, keep=EVENTS))


def case_file_parties(s, d):
    return dossier.parties(*case_graph(s, d))


def case_file_events(s, d):
    return dossier.timeline(*case_graph(s, d, keep=EVENTS)).select("dossier", F.col("event_kind").alias("kind"), "event_date", "chunk_id")


def contract_parties(s, d):
    return dossier.contract_parties(*case_graph(s, d))


def contract_obligations(s, d):
    return dossier.contract_obligations(*case_graph(s, d, keep=DUTIES))


def contract_review(s, d):
    return dossier.contract_review(*case_graph(s, d, keep=DUTIES))


def case_file_review(s, d):
    return dossier.case_file_review(*case_graph(s, d, keep=EVENTS))


def risk_review(s, d):
    return dossier.risk_review(*case_graph(s, d))


def graph_intent_timeline(s, d):
    return dossier.run_intent("procedural_timeline", *case_graph(s, d, keep=EVENTS), "d7")


def graph_delete_document(s, d):
    nodes, edges = graph.delete_document(*case_graph(s, d), "o1")
    return nodes.groupBy("label").count().unionByName(edges.groupBy(F.col("type").alias("label")).count()).withColumnRenamed("count", "n")


def graph_upsert(s, d):
    nodes = case_graph(s, d)[0].filter("label = 'Party'")
    new = nodes.filter(F.substring("id", -1, 1) == "5").withColumn("props", F.lit('{"canonical_name":"new"}')).unionByName(s.createDataFrame([("Party", "cx", None, "{}")], nodes.schema))
    return graph.graph_upsert(nodes, new, ["label", "id"]).select("id", graph.prop("canonical_name").alias("name"))


# -- the same in SQL

BASE_SQL = f"""{LINES_SQL},
o AS (SELECT 'o' || o_orderkey AS doc_id, CASE WHEN o_custkey % 3 <> 0 THEN 'd' || o_custkey END AS dossier, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS doc_type, 'c' || o_custkey AS party, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS role FROM orders),
ch AS (SELECT 'o' || l_orderkey AS doc_id, 'o' || l_orderkey || '-' || l_linenumber AS chunk_id, * FROM li WHERE 'o' || l_orderkey IN (SELECT doc_id FROM o)),
ev AS (SELECT dossier, doc_id, chunk_id, 'e' || chunk_id AS event_id, l_returnflag AS event_kind, strftime(l_shipdate, '%Y-%m-%d') AS event_date, CASE WHEN l_linenumber < 4 THEN strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS deadline_date FROM ch JOIN o USING (doc_id) WHERE l_linestatus = 'F' AND dossier IS NOT NULL),
ro AS (SELECT doc_id, dossier, c_name AS value, role FROM o JOIN customer ON party = 'c' || c_custkey),
ob AS (SELECT doc_id, CASE WHEN l_quantity > 10 THEN 'pay' END AS kind, 'part ' || l_partkey AS text, chunk_id FROM ch WHERE l_returnflag = 'R')"""
PARTIES_SQL = "SELECT DISTINCT dossier, value, role FROM ro WHERE dossier IS NOT NULL"

QUERIES = {f.__name__: f for f in (case_file_documents, procedural_timeline, case_file_parties, case_file_events, contract_parties, contract_obligations, contract_review, case_file_review, risk_review, graph_intent_timeline, graph_delete_document, graph_upsert)}
ORACLE = {
    "case_file_documents": f"WITH {BASE_SQL} SELECT dossier, doc_id, doc_type FROM o WHERE dossier IS NOT NULL",
    "procedural_timeline": f"WITH {BASE_SQL} SELECT * FROM ev",
    "case_file_parties": f"WITH {BASE_SQL} {PARTIES_SQL}",
    "case_file_events": f"WITH {BASE_SQL} SELECT dossier, event_kind AS kind, event_date, chunk_id FROM ev",
    "contract_parties": f"WITH {BASE_SQL} SELECT doc_id, value, role FROM ro",
    "contract_obligations": f"WITH {BASE_SQL} SELECT * FROM ob",
    "contract_review": f"WITH {BASE_SQL} SELECT doc_id, 'party:' || coalesce(role, 'unknown') AS field, value, NULL AS chunk_id FROM ro UNION ALL SELECT doc_id, 'obligation:' || coalesce(kind, ''), text, chunk_id FROM ob",
    "case_file_review": f"""WITH {BASE_SQL} SELECT dossier, 'document:' || coalesce(doc_type, 'unknown') AS field, doc_id AS value, NULL AS chunk_id FROM o WHERE dossier IS NOT NULL
UNION ALL SELECT dossier, 'party:' || coalesce(role, 'unknown'), value, NULL FROM ({PARTIES_SQL}) UNION ALL SELECT dossier, 'event:' || event_kind, event_date, chunk_id FROM ev""",
    "risk_review": f"""WITH {BASE_SQL}, r AS (SELECT doc_id, dossier, 'r' || chunk_id AS risk_id, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'moyen' ELSE 'low' END AS severity FROM ch JOIN o USING (doc_id) WHERE l_returnflag = 'R')
SELECT *, CASE severity WHEN 'high' THEN 0 ELSE 2 END AS severity_rank, CASE severity WHEN 'high' THEN 'Relecture immédiate par l''avocat requise avant signature.' WHEN 'moyen' THEN 'Relecture par l''avocat recommandée avant exécution.' ELSE 'À noter pour référence — risque faible.' END AS recommendation FROM r""",
    "graph_intent_timeline": f"WITH {BASE_SQL} SELECT * FROM ev WHERE dossier = 'd7'",
    "graph_delete_document": f"""WITH {LINES_SQL}, l AS (SELECT * FROM li WHERE l_orderkey <> 1), o AS (SELECT * FROM orders WHERE o_orderkey <> 1)
SELECT * FROM (SELECT 'Document' AS label, count(*) AS n FROM o UNION ALL SELECT 'Chunk', count(*) FROM l UNION ALL SELECT 'Event', count(*) FROM l WHERE l_linestatus = 'F' UNION ALL SELECT unnest(['Obligation', 'Risk', 'HAS_RISK']), count(*) FROM l WHERE l_returnflag = 'R'
UNION ALL SELECT 'Party', count(*) FROM customer UNION ALL SELECT 'PARTY_TO', count(*) FROM o UNION ALL SELECT 'HAS_CHUNK', count(*) FROM l UNION ALL SELECT 'MENTIONS', (SELECT count(*) FROM l WHERE l_linestatus = 'F') + (SELECT count(*) FROM l WHERE l_returnflag = 'R'))""",
    "graph_upsert": "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 10 = 5 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT 'cx', NULL",
}
