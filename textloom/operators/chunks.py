"""Texts into chunks of characters, and cross-document resolution of mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors

#: Characters before a chunk's end in which a sentence end is looked for. Fixed value.
LOOK_BACK = 200


def _sentence_end(text: str, start: int, target: int) -> int:
    for i in range(target - 1, max(0, target - LOOK_BACK) - 1, -1):
        c = text[i]
        if c in "。！？" or (c in ".!?" and (i + 1 >= len(text) or text[i + 1].isspace())):
            end = i + 1
            while end < len(text) and text[end].isspace():
                end += 1
            if end > start:
                return end
    return _word_start(text, start, target)


def _word_start(text: str, start: int, target: int) -> int:
    if target >= len(text):
        return len(text)
    for i in range(target - 1, start - 1, -1):
        if text[i].isspace():
            return i + 1
    return target


def chunk_text(text: str, size: int, overlap: int, sentences: bool = True) -> list[tuple[int, int]]:
    """(start, end) of chunks: of `size` characters, the end moved back to a sentence end or word start; the next begins `overlap` before it, or one on."""
    if not text:
        return []
    out, at = [], 0
    while True:
        target = min(at + size, len(text))
        end = len(text) if target >= len(text) else _sentence_end(text, at, target) if sentences else _word_start(text, at, target)
        out.append((at, end))
        if end >= len(text):
            return out
        at = end - overlap if end - overlap > at else at + 1


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 100, sentences: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, idx, start, end, text) of each document's chunks; null and empty texts have none."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, s, e, t[s:e]) for i, t in zip(rows["doc_id"], rows["text"], strict=True) if t for k, (s, e) in enumerate(chunk_text(t, size, overlap, sentences))]
            yield pd.DataFrame(out, columns=["doc_id", "idx", "start", "end", "text"])

    return kept.mapInPandas(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, idx int, start int, end int, text string")


def content_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with content_id, a digest of the text."""
    return docs.withColumn("content_id", F.sha2(F.col(text), 256))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, a digest of document and number."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("idx").cast("string")), 256))


def candidate_pairs(mentions: DataFrame, mention_id: str = "id", text: str = "text", bands: int = 5, rows: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of mentions that share a band of their MinHash signature, with the signatures' similarity.

    Equal texts are one key, so copies are never paired off; the first
    id stands for each text.
    """
    texts = mentions.groupBy(F.lower(text).alias("t")).agg(F.min(mention_id).alias("id"))
    signed = texts.select("id", vectors.minhash(vectors.shingles(F.col("t")), bands * rows).alias("sig"))
    banded = signed.select("id", "sig", F.explode(vectors.band_hashes(F.col("sig"), bands, rows)).alias("x")).select("id", "sig", "x.band", "x.hash")
    a = banded.select("band", "hash", F.col("id").alias("a"), F.col("sig").alias("sa"))
    b = banded.select("band", "hash", F.col("id").alias("b"), F.col("sig").alias("sb"))
    met = a.join(b, ["band", "hash"]).filter("a < b").groupBy("a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    return met.select("a", "b", vectors.signature_similarity(F.col("sa"), F.col("sb")).alias("similarity"))
