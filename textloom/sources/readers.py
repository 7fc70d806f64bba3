"""Readers of annotated corpora and folders; all lines are read by Spark, so paths may be in any store.

``read(kind, spark, path)`` chooses by name. Token corpora give rows
(source, sentence, position, token, tag); others keep their own columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.storage import stash

#: Files of a listing that are one range.
RANGE_ROWS = 100_000
#: Extensions that ingestion takes. Fixed values.
EXTENSIONS = "txt md markdown rst pdf docx doc odt rtf html htm csv tsv xlsx xls pptx eml msg json xml".split()
#: Folders and files made by the tools themselves. Fixed values.
SKIPPED = r"(^|/)(anon|vault|\.[^/]*)(/|$)|\.anon\.[^/]+$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, n, line): the lines of each file in order; files are read whole, one to a task at least."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return whole.select("source", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def token_lines(spark: SparkSession, path: str, sep: str = r"\s+", token: int = 0, tag: int = -1, comment: str = "#", number: Callable[[Column], Column] | None = None) -> DataFrame:
    """Column files: a token a line, blank lines between sentences; token and tag by place (-1: the last). Lines of comments and without a tag go."""
    lines = _lines(spark, path)
    order = Window.partitionBy("source").orderBy("n")
    blank = F.trim("line") == ""
    rows = lines.withColumn("sentence", F.sum(blank.cast("int")).over(order)).filter(~blank & ~F.col("line").startswith(comment) & ~F.col("line").startswith("-DOCSTART-"))
    parts = F.split(F.col("line"), sep)
    at = lambda k: F.try_element_at(parts, F.lit(k + 1 if k >= 0 else k))
    rows = rows.filter(F.size(parts) > 1)
    if number is not None:
        rows = rows.filter(number(parts))
    return rows.select("source", "sentence", F.row_number().over(Window.partitionBy("source", "sentence").orderBy("n")).alias("position"), at(token).alias("token"), at(tag).alias("tag"))


def jsonl_tokens(spark: SparkSession, path: str, tokens: str = "tokens", tags: str = "ner_tags", labels: list[str] | None = None) -> DataFrame:
    """One sentence a line with arrays of tokens and tags; labels: names of numbered tags."""
    kind = "array<int>" if labels else "array<string>"
    rows = spark.read.schema(f"{tokens} array<string>, {tags} {kind}").json(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("sentence"), F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag"))).alias("k", "x"))
    tag = F.element_at(F.array(*map(F.lit, labels)), F.col("x.tag") + 1) if labels else F.col("x.tag")
    return rows.select("source", "sentence", (F.col("k") + 1).alias("position"), F.col("x.token").alias("token"), tag.alias("tag"))


def rows_api(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A datasets-server page: the `row` of each of its `rows`; row: the DDL of its struct."""
    return spark.read.schema(f"rows array<struct<row:struct<{row}>>>").json(path, multiLine=True).select(F.explode("rows").alias("r")).select("r.row.*")


def json_lines(spark: SparkSession, path: str, schema: str, explode: str | None = None) -> DataFrame:
    """One document a line under a stated schema; explode: an array column of structs to turn into rows."""
    rows = spark.read.schema(schema).json(path)
    if explode is None:
        return rows
    return rows.select(*(c for c in rows.columns if c != explode), F.posexplode(explode).alias("k", "x")).select(*(c for c in rows.columns if c != explode), "k", "x.*")


def json_document(spark: SparkSession, path: str, schema: str, explode: str) -> DataFrame:
    """One whole document: rows of one of its arrays."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(explode).alias("x")).select("x.*")


def labelled_tsv(spark: SparkSession, path: str, header: bool = True, text: int = 0, label: int = 1) -> DataFrame:
    """Tab-separated rows as (text, label) by place."""
    rows = spark.read.csv(path, sep="\t", header=header, quote="")
    names = rows.columns
    return rows.select(F.col(names[text]).alias("text"), F.col(names[label]).alias("label"))


def trec(spark: SparkSession, path: str) -> DataFrame:
    """Lines `LABEL:fine question`: the coarse label and the question."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_extract("value", r"^([A-Za-z]+)", 1).alias("label"), F.regexp_extract("value", r"^\S+\s+(.*)$", 1).alias("text"))


def gap(spark: SparkSession, path: str) -> DataFrame:
    """Pronoun rows with two candidates and their truth."""
    return spark.read.csv(path, sep="\t", header=True, quote="").select("ID", "Text", "Pronoun", F.col("Pronoun-offset").cast("int").alias("pronoun_offset"), "A", F.col("A-offset").cast("int").alias("a_offset"), (F.lower("A-coref") == "true").alias("a_coref"), "B", F.col("B-offset").cast("int").alias("b_offset"), (F.lower("B-coref") == "true").alias("b_coref"))


def brat(spark: SparkSession, path: str) -> DataFrame:
    """Text-bound annotations: (source, id, label, start, end, text); of a discontinuous one the hull."""
    m = r"^(T\d+)\t(\S+) (\d+)[^\t]*?(\d+)\t(.*)$"
    rows = _lines(spark, path).filter(F.col("line").rlike(m))
    return rows.select("source", *(F.regexp_extract("line", m, k).cast(t).alias(n) for k, (n, t) in enumerate((("id", "string"), ("label", "string"), ("start", "int"), ("end", "int"), ("text", "string")), 1)))


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object): brackets, quotes, language and type marks off."""
    m = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"[^.]*)\s*\.\s*$'
    rows = spark.read.text(path).filter(F.col("value").rlike(m))
    return rows.select(F.regexp_extract("value", m, 1).alias("subject"), F.regexp_extract("value", m, 2).alias("predicate"), F.concat(F.regexp_extract("value", m, 3), F.regexp_extract("value", m, 4)).alias("object"))


def json_ld(spark: SparkSession, path: str, node: str = "`@id` string, `@type` string, text string, start int, `end` int, confidence double") -> DataFrame:
    """Rows of the @graph of a document."""
    return spark.read.schema(f"`@graph` array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in node.split(','))}>>").json(path, multiLine=True).select(F.explode("@graph").alias("x")).select("x.*")


def litbank_coref(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source, mention, start_sentence, start, end_sentence, end, text, type, chain): MENTION lines with the chain of their COREF line; a mention without one is a chain of its own."""
    parts = _lines(spark, path).select("source", F.split("line", "\t").alias("p"))
    field = lambda k: F.try_element_at("p", F.lit(k + 1))
    number = lambda k: field(k).try_cast("int")
    said = parts.filter(field(0) == "MENTION").select("source", field(1).alias("mention"), number(2).alias("start_sentence"), number(3).alias("start"), number(4).alias("end_sentence"), (number(5) + 1).alias("end"), field(6).alias("text"), field(7).alias("type"))
    chains = parts.filter(field(0) == "COREF").select("source", field(1).alias("mention"), field(2).alias("chain"))
    return said.join(chains, ["source", "mention"], "left").withColumn("chain", F.coalesce("chain", "mention"))


def ecb_plus(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source, mention, kind, tokens, text, chain) of the markables of each document: the ids and words of their tokens, and the note, else id, of the relation over documents that they are a source of."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    every = lambda pattern, group=0: F.regexp_extract_all("value", F.lit(pattern), F.lit(group))
    attribute = lambda c, name: F.nullif(F.regexp_extract(c, rf'\b{name}="([^"]*)"', 1), F.lit(""))
    words = whole.select("source", F.explode(every(r"<token [^>]*>[^<]*</token>")).alias("x")).select("source", attribute("x", "t_id").cast("int").alias("t"), F.regexp_extract("x", ">([^<]*)<", 1).alias("word"))
    marked = whole.select("source", F.explode(every(r"(?s)<([A-Z_]+) [^>]*\bm_id=\"[^\"]*\"[^>/]*>(?:\s*<token_anchor [^>]*/>)+\s*</\1>")).alias("x")).select("source", attribute("x", "m_id").alias("mention"), F.regexp_extract("x", "^<([A-Z_]+)", 1).alias("kind"), F.regexp_extract_all("x", F.lit(r'token_anchor t_id="(\d+)"'), F.lit(1)).cast("array<int>").alias("tokens"))
    related = whole.select("source", F.explode(every(r"(?s)<CROSS_DOC_COREF [^>]*>.*?</CROSS_DOC_COREF>")).alias("x")).select("source", F.coalesce(attribute("x", "note"), attribute("x", "r_id")).alias("chain"), F.explode(F.regexp_extract_all("x", F.lit(r'<source m_id="([^"]*)"'), F.lit(1))).alias("mention"))
    texts = marked.select("source", "mention", F.explode("tokens").alias("t")).join(words, ["source", "t"]).groupBy("source", "mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "word"))), lambda x: x.word), " ").alias("text"))
    return marked.join(texts, ["source", "mention"], "left").join(related, ["source", "mention"], "left")


def maven_arguments(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, k, type, role, content, entity_id): each argument of the k-th event of a document."""
    schema = "id string, events array<struct<type:string,argument:map<string,array<struct<content:string,entity_id:string>>>>>"
    events = json_lines(spark, path, schema, explode="events").select("id", "k", "type", F.explode("argument").alias("role", "said"))
    return events.select("id", "k", "type", "role", F.inline("said"))


def candidates(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    """(path, size, mtime, ext) of the supported files under a folder, those under the folder `without` left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), ext.alias("ext")).filter(F.col("ext").isin(EXTENSIONS))
    relative = F.regexp_replace("path", F.lit("^.*?" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/"), F.lit(""))
    listed = listed.filter(~relative.rlike(SKIPPED))
    if without is None:
        return listed
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    top = re.sub("^[a-z0-9]+:/*", "/", without).rstrip("/") + "/"
    return listed.filter(~plain.startswith(top))


def count_candidates(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    """One row (files, bytes) of the supported files under a folder."""
    return candidates(spark, folder, without).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _folded(left: int, room: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Files gone through in order: at most room of them, each that fits what is left."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        keep, rest = [], left
        for i, size in rows.sort_values("path")["size"].items():
            if len(keep) >= room:
                break
            if size <= rest:
                keep.append(i)
                rest -= size
        return rows.loc[keep]

    return fold


def within_budget(listed: DataFrame, max_files: int, max_bytes: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of listed (path, size, …) that are kept in order of path: at most max_files; one that does not fit the bytes left is passed over, later ones may.

    The listing is dealt by ranges of paths. A range that fits whole, or of which
    nothing fits, is settled by its sums alone; only a range in which the budget
    bites is gone through file by file, in a task of its own.
    """
    ranges = max(1, -(-listed.count() // range_rows))
    dealt = stash(listed.repartitionByRange(ranges, "path").withColumn("__part", F.spark_partition_id()), "listing")
    sums = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("least")).orderBy("__part").collect()
    left, room, whole, parts = max_bytes, max_files, [], []
    for r in sums:
        if room <= 0:
            break
        if r.bytes <= left and r.n <= room:
            whole.append(r["__part"])
            left, room = left - r.bytes, room - r.n
        elif r.least <= left:
            part = stash(dealt.filter(F.col("__part") == r["__part"]).groupBy("__part").applyInPandas(_folded(left, room), dealt.schema), "listing")
            used = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
            left, room = left - used[1], room - used[0]
            parts.append(part)
    kept = dealt.filter(F.col("__part").isin(whole))
    for part in parts:
        kept = kept.unionByName(part)
    return kept.drop("__part")


def discover(spark: SparkSession, folder: str, max_files: int, max_bytes: int) -> DataFrame:
    """(path, size, mtime, ext, sha256) of the supported files under a folder that ``within_budget`` keeps; digests are taken of their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return within_budget(candidates(spark, folder), max_files, max_bytes).join(files.select("path", F.sha2(F.col("content"), 256).alias("sha256")), "path")


#: Readers by the name of a corpus format.
READERS: dict[str, Callable[..., DataFrame]] = {
    "conll": token_lines,
    "tsv_ner": partial(token_lines, sep="\t", token=0, tag=1),
    "csv_ner": partial(token_lines, sep=",", token=1, tag=-1),
    "conllu": partial(token_lines, sep="\t", token=1, tag=3, number=lambda p: F.element_at(p, 1).rlike(r"^\d+$")),
    "bc5cdr": partial(token_lines, sep="\t", token=0, tag=-1),
    "ncbi_disease": partial(token_lines, sep=r"[\t ]", token=0, tag=-1),
    "jsonl_ner": jsonl_tokens,
    "wikiann": partial(jsonl_tokens, labels=["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]),
    "tweetner7": partial(jsonl_tokens, tags="tags"),
    "rows_api": rows_api,
    "cadec_rows": partial(rows_api, row="text:string,ade:string,term_PT:string"),
    "cadec_jsonl": partial(json_lines, schema="text string, entities array<struct<start:int,end:int,label:string>>", explode="entities"),
    "gap": gap,
    "preco": partial(json_lines, schema="id string, sentences array<array<string>>, mention_clusters array<array<array<int>>>"),
    "litbank": partial(token_lines, sep="\t", token=0, tag=1),
    "docred": partial(json_lines, schema="sentence array<string>, ner array<struct<start:int,end:int,type:string>>", explode="ner"),
    "docred_relations": partial(json_lines, schema="relations array<struct<head:int,tail:int,type:string>>", explode="relations"),
    "google_re": partial(json_lines, schema="sub string, obj string, pred string, evidences array<struct<url:string,snippet:string>>", explode="evidences"),
    "chisiec": partial(json_document, schema="entities array<struct<type:string,start:int,`end`:int>>", explode="entities"),
    "chisiec_relations": partial(json_document, schema="relations array<struct<type:string,head:int,tail:int>>", explode="relations"),
    "maven": partial(json_lines, schema="id string, events array<struct<type:string,mention:array<struct<trigger_word:string,sent_id:int>>>>", explode="events"),
    "rams": partial(json_lines, schema="doc_key string, sentences array<array<string>>, evt_triggers array<array<string>>, gold_evt_links array<array<string>>"),
    "casie": partial(json_lines, schema="id string, content string, event array<struct<type:string,subtype:string>>", explode="event"),
    "afrisenti": labelled_tsv,
    "masakhanews": partial(labelled_tsv, text=1, label=0),
    "afriqa": partial(json_lines, schema="id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>"),
    "trec": trec,
    "agnews": partial(json_lines, schema="text string, label int"),
    "dbpedia14": partial(json_lines, schema="title string, content string, label int"),
    "yahoo_answers": partial(json_lines, schema="question_title string, question_content string, best_answer string, topic int"),
    "tweettopic": partial(json_lines, schema="text string, label int, label_name string"),
    "litbank_coref": litbank_coref,
    "ecb_plus": ecb_plus,
    "maven_arg": maven_arguments,
    "brat": brat,
    "n_triples": n_triples,
    "json_ld": json_ld,
}


def read(kind: str, spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of a corpus by the name of its format."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
