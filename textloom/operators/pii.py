"""Structured personal data: pattern scan, report, redaction, masking, stable tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (pattern, type, risk), in the order in which they claim places. Fixed values.
PATTERNS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "ID_NUMBER", "CRITICAL"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "ID_NUMBER", "CRITICAL"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]{0,16})?\b", "ID_NUMBER", "CRITICAL"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "CONTACT", "HIGH"),
    (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "CONTACT", "HIGH"),
    (
        r"\b\d{1,5}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir|Terrace|Ter)\.?(?:,\s*[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?\b",
        "ADDRESS",
        "HIGH",
    ),
)
#: For each pattern a character that a text must have for it, of a class, and the class that all its matches start with, if few characters are of it.
_NEEDS = ((r"\d", r"\d"), (r"\d", r"\d"), (r"\d", None), ("@", None), (r"\d", r"[+(\d]"), (r"\d", r"\d"))
_compiled = [(re.compile(p, re.ASCII), kind, risk, re.compile(need, re.ASCII), start and re.compile(start, re.ASCII)) for (p, kind, risk), (need, start) in zip(PATTERNS, _NEEDS, strict=True)]
#: Types that identify a person directly. Fixed values.
DIRECT = "ID_NUMBER NATIONAL_ID_FR NATIONAL_ID_ES NATIONAL_ID_IT NATIONAL_ID_PL NATIONAL_ID_NL NATIONAL_ID_BE TAX_ID_SIRET TAX_ID_SIREN TAX_ID_VAT LICENSE_PLATE_EU".split()
SPANS = "array<struct<start:int,end:int,type:string,risk:string,text:string>>"


def _matches(text: str, pattern: re.Pattern, need: re.Pattern, start: re.Pattern | None) -> Iterator[re.Match]:
    """What pattern.finditer gives, tried only where a match may start: trying every place of a text costs most of a scan."""
    if not need.search(text):
        return
    if start is None:
        yield from pattern.finditer(text)
        return
    end = 0
    for at in start.finditer(text):
        if at.start() >= end and (m := pattern.match(text, at.start())):
            yield m
            end = m.end()


def _find(text: str) -> list[tuple[int, int, str, str, str]]:
    found: list[tuple[int, int, str, str, str]] = []
    for pattern, kind, risk, need, start in _compiled:
        for m in _matches(text, pattern, need, start):
            if all(m.end() <= s or m.start() >= e for s, e, *_ in found):
                found.append((m.start(), m.end(), kind, risk, m.group()))
    return found


def possible(text: Column) -> Column:
    """Whether ``scan`` may find anything in a text: it has a character that some pattern needs. A null text gives null."""
    return text.rlike("[0-9@]")


def scan(text: Column) -> Column:
    """Spans of the patterns as an array, those of earlier patterns first; offsets in characters. A null text gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [dict(zip(("start", "end", "type", "risk", "text"), s, strict=True)) for s in _find(t)] for t in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPANS)(text)


def _kept(spans: list[dict]) -> list[dict]:
    """Without overlaps: by start, the longer first."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            out.append(s)
            end = s["end"]
    return out


def _fold(text: str, spans: list[dict], new) -> str:
    for s in reversed(_kept(spans)):
        text = text[: s["start"]] + new(s) + text[s["end"] :]
    return text


def _rewritten(text: Column, spans: Column, make) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([None if t is None else _fold(t, list(s) if s is not None else [], make()) for t, s in zip(texts, found, strict=True)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text, spans)


def redact(text: Column, spans: Column) -> Column:
    """[TYPE_n] for each span, numbered from the last one backwards."""

    def make():
        n: Counter = Counter()

        def new(s: dict) -> str:
            n[s["type"]] += 1
            return f"[{s['type']}_{n[s['type']]}]"

        return new

    return _rewritten(text, spans, make)


def mask(text: Column, spans: Column, fill: str = "*") -> Column:
    """The fill for each character of a span."""
    return _rewritten(text, spans, lambda: lambda s: fill * (s["end"] - s["start"]))


def fingerprint(text: Column, spans: Column) -> Column:
    """[TYPE_8hex] for each span, from a digest of its text."""
    import hashlib

    return _rewritten(text, spans, lambda: lambda s: f"[{s['type']}_{hashlib.blake2b(s['text'].encode(), digest_size=4).hexdigest()}]")


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """For each document of rows (doc_id, type, text): counts by class and a risk: critical with a direct identifier; high with more than five names, a date of birth and an address; medium with more than three names; else low."""
    t = F.col("type")
    names = F.countDistinct(F.when(t == "PERSON", F.lower("text")))
    direct, dates, places = F.count_if(t.isin(DIRECT)), F.count_if(t == "DOB"), F.count_if(t == "ADDRESS")
    risk = F.when(direct > 0, "CRITICAL").when((names > 5) & (dates > 0) & (places > 0), "HIGH").when(names > 3, "MEDIUM").otherwise("LOW")
    return found.groupBy(doc_id).agg(F.count_if(t == "PERSON").alias("persons"), dates.alias("dates"), places.alias("addresses"), F.count_if(t == "CONTACT").alias("contacts"), direct.alias("identifiers"), risk.alias("risk"))


def vault_tokens(values: DataFrame, vault: DataFrame, kind: str = "type", value: str = "text") -> DataFrame:
    """The vault (type, text, token) with a token TYPE_n for each value it lacks; known ones keep theirs. New ones are numbered after the greatest of their type, in order of the value."""
    from pyspark.sql import Window

    new = values.select(F.col(kind).alias("type"), F.col(value).alias("text")).distinct().join(vault, ["type", "text"], "left_anti")
    last = vault.groupBy("type").agg(F.max(F.regexp_extract("token", r"(\d+)$", 1).cast("long")).alias("last"))
    ranked = new.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("text"))).join(last, "type", "left")
    return vault.select("type", "text", "token").unionByName(ranked.select("type", "text", F.concat("type", F.lit("_"), F.coalesce("last", F.lit(0)) + F.col("k")).alias("token")))


def tokens_possible(text: Column) -> Column:
    """Whether ``rehydrate`` may find a token TYPE_n in a text. A null text gives null."""
    return text.rlike("_[0-9]")


def rehydrate(texts: DataFrame, vault: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text) with every known token TYPE_n replaced by its value; others stay. Tokens meet the vault by a join."""
    pieces = texts.select(doc_id, F.posexplode(F.split(F.col(text), r"(?<![A-Z_0-9])(?=[A-Z][A-Z_]*_\d+)|(?<=[A-Z]_\d{1,9})(?!\d)")).alias("k", "piece"))
    met = pieces.join(vault.select(F.col("token").alias("piece"), F.col("text").alias("__v")), "piece", "left")
    return met.groupBy(doc_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("__v", "piece").alias("p")))), lambda x: x.p), "").alias(text))
