"""Reviews of case files and contracts over a property graph; nodes and edges as in ``graph``, edges with props too.

A dossier is what documents name in the property dossier_id. Every function
covers all dossiers, documents or parties at once; filter the frame that comes
back, and Catalyst pushes the filter to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import graph
from textloom.operators.graph import edges_of, nodes_of, prop

#: What is advised at a severity. Fixed values.
ADVICE = {
    ("high", "critique", "élevé"): "Relecture immédiate par l'avocat requise avant signature.",
    ("medium", "moyen", "modéré"): "Relecture par l'avocat recommandée avant exécution.",
}
NO_ADVICE = "À noter pour référence — risque faible."


def documents(nodes: DataFrame) -> DataFrame:
    """Rows (dossier, doc_id, doc_type) of the documents that name a dossier."""
    return nodes_of(nodes, "Document", "d").select(prop("dossier_id", "d_props").alias("dossier"), F.col("d_id").alias("doc_id"), prop("doc_type", "d_props").alias("doc_type")).filter("dossier is not null")


def _roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, value, role): names of the parties to each document."""
    ends = edges.filter("type = 'PARTY_TO'").select(F.col("from_id").alias("p_id"), F.col("to_id").alias("doc_id"), prop("role").alias("role"))
    return ends.join(nodes_of(nodes, "Party", "p"), "p_id").select("doc_id", prop("canonical_name", "p_props").alias("value"), "role")


def _mentioned(docs: DataFrame, nodes: DataFrame, edges: DataFrame, label: str, **props: str) -> DataFrame:
    """docs (doc_id, …) with chunk_id, x_id and properties by name: nodes of a label that their chunks mention. What is joined by chunk is joined before what is joined by document, so chunks are dealt once."""
    found = nodes_of(nodes, label, "x").select("x_id", *(prop(p, "x_props").alias(name) for name, p in props.items()))
    said = edges_of(edges, "MENTIONS").toDF("chunk_id", "x_id").join(found, "x_id")
    chunks = edges_of(edges, "HAS_CHUNK").toDF("doc_id", "chunk_id").join(nodes_of(nodes, "Chunk", "c").select(F.col("c_id").alias("chunk_id")), "chunk_id")
    return chunks.join(said, "chunk_id").join(docs, "doc_id")


def timeline(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (dossier, doc_id, chunk_id, event_id, event_kind, event_date, deadline_date) of the events that a dossier's chunks mention."""
    rows = _mentioned(documents(nodes).select("dossier", "doc_id"), nodes, edges, "Event", event_kind="kind", event_date="event_date", deadline_date="deadline_date")
    return rows.select("dossier", "doc_id", "chunk_id", F.col("x_id").alias("event_id"), "event_kind", "event_date", "deadline_date")


def parties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct rows (dossier, value, role) of the parties to a dossier's documents."""
    return _roles(nodes, edges).join(documents(nodes).select("dossier", "doc_id"), "doc_id").select("dossier", "value", "role").distinct()


def contract_obligations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, text, chunk_id) of the obligations that a document's chunks mention."""
    return _mentioned(nodes_of(nodes, "Document", "doc").select("doc_id"), nodes, edges, "Obligation", kind="kind", text="text_pseudo").select("doc_id", "kind", "text", "chunk_id")


def contract_parties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, value, role) of the parties to each document, repeats kept."""
    return _roles(nodes, edges)


def _field(name: str, what: str, missing: str) -> Column:
    return F.concat(F.lit(f"{name}:"), F.coalesce(F.col(what), F.lit(missing))).alias("field")


def contract_review(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, field, value, chunk_id): a party: row for each role, an obligation: row for each kind."""
    who = contract_parties(nodes, edges).select("doc_id", _field("party", "role", "unknown"), F.coalesce("value", F.lit("")).alias("value"), F.lit(None).cast("string").alias("chunk_id"))
    what = contract_obligations(nodes, edges).select("doc_id", _field("obligation", "kind", ""), F.coalesce("text", F.lit("")).alias("value"), "chunk_id")
    return who.unionByName(what)


def case_file_review(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (dossier, field, value, chunk_id) of a dossier's documents, parties and events."""
    none = F.lit(None).cast("string").alias("chunk_id")
    docs = documents(nodes).select("dossier", _field("document", "doc_type", "unknown"), F.col("doc_id").alias("value"), none)
    who = parties(nodes, edges).select("dossier", _field("party", "role", "unknown"), F.coalesce("value", F.lit("")).alias("value"), none)
    events = timeline(nodes, edges).select("dossier", _field("event", "event_kind", ""), F.coalesce("event_date", F.lit("")).alias("value"), "chunk_id")
    return docs.unionByName(who).unionByName(events)


def advice(severity: Column) -> Column:
    """What to do at a severity; an unknown one counts as low."""
    out = F.lit(NO_ADVICE)
    for words, said in ADVICE.items():
        out = F.when(severity.isin(*words), said).otherwise(out)
    return out


def risk_review(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, dossier, risk_id, severity, severity_rank, recommendation) of all risks of documents; filter by either scope."""
    found = graph.risk_findings(nodes, edges)
    return found.join(documents(nodes).select("doc_id", "dossier"), "doc_id", "left").withColumn("recommendation", advice(F.coalesce("severity", F.lit(""))))


#: Named graph queries, each (nodes, edges, argument) -> rows.
INTENTS: dict[str, Callable[..., DataFrame]] = {
    "party_dossier": graph.party_dossier,
    "obligations_owed_by": graph.obligations_of,
    "citation_chain": graph.citing,
    "procedural_timeline": lambda nodes, edges, dossier: timeline(nodes, edges).filter(F.col("dossier") == dossier),
    "appeal_chain": lambda nodes, edges, start: graph.appeal_chain(edges, *start),
}


def run_intent(name: str, nodes: DataFrame, edges: DataFrame, argument: str | tuple[str, int]) -> DataFrame:
    """The rows of a named query; appeal_chain takes (document, depth)."""
    return INTENTS[name](nodes, edges, argument)
