"""Token counts behind a digest cache.

A text's count is a function of its normalised content and the tokenizer's
version. Both digests are joined to stored counts; only texts without one are
encoded, each distinct content once, and their counts are appended.

Normalising for the digest undoes only what the tokenizer itself undoes (see
``normalised``), so texts of one digest always have one count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import extended, fresh_path, keyed_text, map_slices, slices, stash

#: The pattern of tokenizers that drop white space and never join what it parts. Fixed value from the vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LIBRARIES = {"json": "tokenizers", "tiktoken": "tiktoken", "model": "sentencepiece"}
#: Word counts that a Python worker remembers before it starts anew.
MEMO_WORDS = 300_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def parts_at_white_space(path: str) -> bool:
    """True if the count of a text is the sum of the counts of its white-space separated words, and case and white space do not matter: read off the vocabulary file."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and pre.get("pattern") == {"Regex": WORD_PATTERN}
        and pre.get("behavior") == "Removed"
        and pre.get("invert") is True
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file, the library's version and the way of counting."""
    library = LIBRARIES[path.rpartition(".")[2]]
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {__import__(library).__version__}|plain".encode()).hexdigest()


class Counter:
    """Token counts of texts by the library that the file belongs to: no begin, end or added special tokens, no truncation."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word, self.memo = parts_at_white_space(path), {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        else:
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: list(map(len, own.encode(texts, num_threads=1)))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        memo, out = self.memo, []
        for text in texts:
            words = text.encode().split()  # at 0x20 and 0x09-0x0D only
            new = [w for w in set(words) if w not in memo]
            if new:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                    new = list(set(words))
                memo.update(zip(new, self.encode([w.decode() for w in new]), strict=True))
            out.append(sum(map(memo.__getitem__, words)))
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this Python worker for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def normalised(text: str, lax: bool) -> bytes:
    """Content that is digested.

    lax (the tokenizer drops white space, folds case and composes): white space
    runs become one space and go at the ends; a text of ASCII only is lower-cased,
    any other composed. A text with a part of a special string stays as it is.
    """
    data = text.encode()
    if not lax or b"<|" in data:
        return b"\0" + data
    if data.isascii():
        return b" ".join(data.lower().split())
    return b" ".join(unicodedata.normalize("NFC", text).encode().split())


def _digests(texts: list[str | None], lax: bool) -> list[bytes]:
    return [hashlib.sha256(normalised(t or "", lax)).digest() for t in texts]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per input row.

    tokenizer: path of a .json or .model file that every executor has. cache:
    folder of stored counts, made if missing and appended to (one writer at a
    time); None: a new one in the shared folder. A null text counts as empty:
    0 tokens. Repeated texts are encoded once; ids may be null or repeat;
    extra columns are left out; an empty table gives no rows. Texts are
    shuffled only on a miss, and of a group of copies at most one for each
    task that read some.
    """
    spark, lax, version = docs.sparkSession, parts_at_white_space(tokenizer), tokenizer_digest(tokenizer)
    keyed = keyed_text(docs, doc_id, text)
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_digests(texts, lax), pa.binary()), pa.array([len((t or "").encode()) for t in texts], pa.int64())], ["doc_id", "digest", "n_bytes"]
        )

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column(0).to_pylist()
                rows = [(d, t or "") for d, t in zip(_digests(texts, lax), texts, strict=True) if not (d in seen or seen.add(d))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.string())], ["digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), set()
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [(d, t) for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) if not (d in seen or seen.add(d))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in rows], pa.binary()), pa.array([version] * len(rows), pa.string()), pa.array(count([t for _, t in rows]), pa.int64())], ["digest", "tokenizer", "n_tokens"]
                )

    here = cache or fresh_path(spark, "token-counts")
    misses = keyed.select("text").mapInArrow(first_of_task, "digest binary, text string")
    if cache and _exists(spark, cache):
        known = stash(spark.read.schema(CACHE_SCHEMA).parquet(here).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known-counts")
        misses = misses.join(known.select("digest").hint("shuffle_hash"), "digest", "left_anti")
    else:
        misses = misses.repartition("digest")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(here)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(here).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    if cache:
        stored = stash(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known-counts")
    rows = map_slices(keyed, narrow, f"doc_id {id_type}, digest binary, n_bytes long").join(stored, "digest")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def with_token_counts(docs: DataFrame, tokenizer: str, out: str = "n_tokens", text: str = "text") -> DataFrame:
    """docs with a column of token counts, without a cache: one pass over the texts, no shuffle. A column of that name is replaced."""
    schema = extended(docs.drop(out).schema, **{out: "long"})
    at = docs.drop(out).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for piece in slices(batch):
                n = count([t or "" for t in piece.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n, pa.int64())], [*piece.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema)
