"""Property graph of documents: nodes (label, id, doc_id, props) and edges (from_label, from_id, to_label, to_id, type, doc_id); props is JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prop(name: str, of: str = "props") -> Column:
    """A property of a node."""
    return F.get_json_object(of, f"$.{name}")


def nodes_of(nodes: DataFrame, label: str, prefix: str) -> DataFrame:
    """Nodes of one label with prefixed columns."""
    return nodes.filter(F.col("label") == label).select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "doc_id", "props")))


def edges_of(edges: DataFrame, kind: str) -> DataFrame:
    """Ends of the edges of one type."""
    return edges.filter(F.col("type") == kind).select("from_id", "to_id")


def step(rows: DataFrame, key: str, edges: DataFrame, kind: str, nodes: DataFrame, label: str, prefix: str, how: str = "inner", back: bool = False) -> DataFrame:
    """rows joined over edges of one type (against their direction if back) to nodes of a label; how=left keeps rows without."""
    e = edges_of(edges, kind)
    near, far = ("to_id", "from_id") if back else ("from_id", "to_id")
    ends = e.select(F.col(near).alias("__near"), F.col(far).alias("__far")).join(nodes_of(nodes, label, prefix), F.col("__far") == F.col(f"{prefix}_id"))
    return rows.join(ends, F.col(key) == F.col("__near"), how).drop("__near", "__far")


def party_dossier(nodes: DataFrame, edges: DataFrame, party: str) -> DataFrame:
    """Party -> documents -> chunks, by date, document and chunk."""
    rows = step(nodes_of(nodes, "Party", "party").filter(F.col("party_id") == party), "party_id", edges, "PARTY_TO", nodes, "Document", "doc")
    rows = step(rows, "doc_id", edges, "HAS_CHUNK", nodes, "Chunk", "chunk")
    return rows.select("party_id", "doc_id", prop("date", "doc_props").alias("document_date"), "chunk_id")


def obligations_of(nodes: DataFrame, edges: DataFrame, party: str) -> DataFrame:
    """Obligations that bind a party, with the chunk that mentions each, or null."""
    rows = step(nodes_of(nodes, "Party", "party").filter(F.col("party_id") == party), "party_id", edges, "BOUND_BY", nodes, "Obligation", "ob")
    return step(rows, "ob_id", edges, "MENTIONS", nodes, "Chunk", "chunk", how="left", back=True).select("party_id", "ob_id", prop("kind", "ob_props").alias("kind"), "chunk_id")


def citing(nodes: DataFrame, edges: DataFrame, article: str) -> DataFrame:
    """Documents that refer to an article, with their own chunks that mention it."""
    refs = edges_of(edges, "REFERENCES").filter(F.col("to_id") == article).select(F.col("from_id").alias("doc"))
    said = edges_of(edges, "MENTIONS").filter(F.col("to_id") == article).select(F.col("from_id").alias("chunk"))
    chunks = nodes_of(nodes, "Chunk", "c").select(F.col("c_id").alias("chunk"), F.col("c_doc_id").alias("doc"))
    return refs.join(said.join(chunks, "chunk"), "doc").select("doc", "chunk")


def risk_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risks of documents, the high before the medium before the rest, then by id."""
    rows = step(nodes_of(nodes, "Document", "doc"), "doc_id", edges, "HAS_RISK", nodes, "Risk", "risk")
    severity = prop("severity", "risk_props")
    return rows.select("doc_id", "risk_id", severity.alias("severity"), F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2).alias("severity_rank"))


def appeal_chain(edges: DataFrame, start: str, depth: int, kind: str = "APPEALS") -> DataFrame:
    """Rows (id, depth, path) reached from start over edges of one type, at most `depth` steps; cycles end there. The number of joins is the depth."""
    hop = edges_of(edges, kind)
    now = edges.sparkSession.createDataFrame([(start, 0, start)], "id string, depth int, path string")
    found = now
    for k in range(1, depth + 1):
        now = now.join(hop, now.id == hop.from_id).select(F.col("to_id").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.lit(">"), "to_id").alias("path"))
        found = found.unionByName(now)
    return found


def graph_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows in the place of those with equal keys; of repeats in new one stays."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete_document(nodes: DataFrame, edges: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a document."""
    keep = ~F.col("doc_id").eqNullSafe(F.lit(doc))
    return nodes.filter(keep), edges.filter(keep)
