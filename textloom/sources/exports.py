"""Annotations and facts as text formats: each function returns rows with a `line` (or document) that ``write.text`` stores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.strings import char_to_byte, uri_safe

BASE = "urn:textloom:"


def brat(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, line): `Tn LABEL start end<TAB>text` with byte offsets, n by start, and `An Confidence Tn 0.00`. docs: doc_id, text; spans: doc_id, start, end, label, confidence."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label"))
    rows = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("n", n)
    surface = F.regexp_replace(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), r"\n", " ")
    bound = F.format_string("T%d\t%s %d %d\t%s", "n", "label", char_to_byte(F.col("text"), F.col("start")), char_to_byte(F.col("text"), F.col("end")), surface)
    sure = F.when(F.col("confidence").isNotNull(), F.format_string("A%d\tConfidence T%d %.2f", "n", "n", "confidence"))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(bound, sure))).alias("line"))


def conll(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, position, line): `token TAG`: B- if the token begins at or before its entity's start, else I-; closing punctuation is a token of its own unless the whole token is inside the entity."""
    held = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    rows = docs.select("doc_id", "text").join(held, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for part in batches:
            out = []
            for i, t, own in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                own = sorted((s["start"], s["end"], s["label"]) for s in own) if own is not None else []
                k = 0
                for m in re.finditer(r"\S+", t or ""):
                    s, e = m.span()
                    hit = next(((a, b, lab) for a, b, lab in own if s < b and e > a), None)
                    body, tail = e, []
                    if not (hit and hit[0] <= s and e <= hit[1]):
                        while body - 1 > s and t[body - 1] in ".,;:!?)]}\"'":
                            body -= 1
                            tail.insert(0, t[body])
                    tag = "O" if hit is None or not (s < hit[1] and body > hit[0]) else ("B-" if s <= hit[0] else "I-") + hit[2]
                    for token, mark in [(t[s:body], tag), *((c, "O") for c in tail)]:
                        out.append((i, k, f"{token} {mark}"))
                        k += 1
            yield pd.DataFrame(out, columns=["doc_id", "position", "line"])

    return rows.mapInPandas(run, T.StructType([docs.schema["doc_id"], T.StructField("position", T.IntegerType()), T.StructField("line", T.StringType())]))


def jsonl(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def n_triples(spans: DataFrame) -> DataFrame:
    """Type, label and document of each entity (id, label, text, doc_id) as triples."""
    quote = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("text", r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
    me = F.concat(F.lit(f"<{BASE}entity:"), uri_safe(F.col("id").cast("string")), F.lit("> "))
    triples = F.array(
        F.concat(me, F.lit(f"<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{BASE}type:"), uri_safe(F.col("label")), F.lit("> .")),
        F.concat(me, F.lit("<http://www.w3.org/2000/01/rdf-schema#label> "), quote, F.lit(" .")),
        F.concat(me, F.lit(f"<{BASE}in> <{BASE}doc:"), uri_safe(F.col("doc_id").cast("string")), F.lit("> .")),
    )
    return spans.select(F.explode(triples).alias("line"))


def json_ld(spans: DataFrame) -> DataFrame:
    """One document for each doc_id: its entities in @graph."""
    node = F.struct(F.concat(F.lit(f"{BASE}entity:"), F.col("id").cast("string")).alias("@id"), F.col("label").alias("@type"), "text", "start", "end")
    return spans.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("https://schema.org/").alias("@context"), F.sort_array(F.collect_list(node)).alias("@graph"))).alias("line"))


def html(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, line): the escaped text with each span in a mark element; of overlapping ones the first, the longer first. Built from pieces, in JVM expressions."""
    from textloom.operators.spans import greedy_nonoverlap

    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    held = spans.groupBy("doc_id").agg(greedy_nonoverlap(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).alias("s"))
    rows = docs.select("doc_id", "text").join(held, "doc_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int,label:string>>")))
    piece = lambda a, b: esc(F.substring(F.col("text"), a + 1, b - a))
    marked = F.transform("s", lambda x, k: F.concat(piece(F.when(k == 0, F.lit(0)).otherwise(F.element_at(F.col("s"), F.greatest(k, F.lit(1))).end), x.start), F.lit('<mark class="'), x.label, F.lit('">'), piece(x.start, x.end), F.lit("</mark>")))
    last = F.when(F.size("s") > 0, F.element_at(F.col("s"), -1).end).otherwise(0)
    return rows.select("doc_id", F.concat(F.array_join(marked, ""), piece(last, F.length("text"))).alias("line"))


def graph_csv(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows with the columns a graph import expects."""
    return nodes.select(F.col("id").alias(":ID"), F.col("label").alias(":LABEL"), "props"), edges.select(F.col("from_id").alias(":START_ID"), F.col("to_id").alias(":END_ID"), F.col("type").alias(":TYPE"))


def audit_chain(events: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events of each UTC day in order with prev_hash and this_hash = sha256(prev_hash and the row's JSON); a day begins with 64 zeros.

    A chain is sequential by nature: one task walks a day, batch by batch, and
    keeps nothing of it but the last hash.
    """
    import hashlib

    rows = events.withColumn("day", F.to_date(ts)).withColumn("json", F.to_json(F.struct(*sorted(events.columns))))
    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("this_hash", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        today, before = object(), ""
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for day, j in zip(batch.column("day").to_pylist(), batch.column("json").to_pylist(), strict=True):
                if day != today:
                    today, before = day, "0" * 64
                out[0].append(before)
                before = hashlib.sha256((before + j).encode()).hexdigest()
                out[1].append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], schema.names)

    return rows.repartition("day").sortWithinPartitions("day", ts, tie).mapInArrow(walk, schema)
