"""Quality rules: word counts and repeats, then how well a public vocabulary fits the text.

Fertility is measured on the words of a text, each encoded on its own by a
vocabulary with byte fallback: characters per token, the share of byte tokens
and the entropy of the tokens (divided by the logarithm of their number, so 1
means that none occurs twice). A text is rejected if a figure is outside the
band of its language (its script where the language is unknown).

A band is the median over all documents of that language and length that pass
the base rules, give or take some median absolute deviations (FIGURES). Lengths
are classed by half octaves of the number of tokens, as entropy falls with it.
A class of fewer than LEAST_DOCS is judged by the whole language, such a
language by the documents of its script (of like length, else all), and such a
script by all documents. Figures are rounded to
steps and counted first, so both medians are exact and do not depend on how
the rows are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import extended, keyed_text, slices, stash

#: Figure: steps to one; in steps: the greatest value, the least half of a band; median absolute deviations in half a band.
FIGURES = {"chars_per_token": (100, 6400, 12, 6), "byte_share": (1000, 1000, 50, 6), "token_entropy": (1000, 1000, 20, 6)}
#: Words of most tokens that are left out of the figures (a secret, an address), so that they decide no short text.
ODD_WORDS = 3
#: Documents below which a language, or one class of lengths of it, has no band of its own.
LEAST_DOCS = 30
#: Bands (one for each language or script) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BANDS = 10_000
MEMO_WORDS = 150_000
#: Rejection by the base rules. Fixed values of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS = b"#*$%&|<>"
_scripts = {
    "latin": re.compile(r"[A-Za-zª-ɏḀ-ỿ]"),
    "greek": re.compile(r"[Ͱ-Ͽ]"),
    "cyrillic": re.compile(r"[Ѐ-ԯ]"),
    "hebrew": re.compile(r"[֐-׿]"),
    "arabic": re.compile(r"[؀-ۿ]"),
    "devanagari": re.compile(r"[ऀ-ॿ]"),
    "thai": re.compile(r"[฀-๿]"),
    "hangul": re.compile(r"[가-힯ᄀ-ᇿ]"),
    "kana": re.compile(r"[぀-ヿ]"),
    "han": re.compile(r"[一-鿿㐀-䶿]"),
}


def script(text: str) -> str:
    """The script of most letters; ties and none: the first of the list and `other`."""
    if _only_latin(text):
        return "latin" if _scripts["latin"].search(text) else "other"
    counts = {k: len(p.findall(text)) for k, p in _scripts.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def _only_latin(text: str) -> bool:
    """Whether a text has characters up to U+00FF alone; those have letters of one script."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice, the first such window included; each word counts once."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    size = np.uint64(len(number))
    pairs = ids[:-1] * size + ids[1:]
    if len(number) >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    windows = pairs[:-1] * size + ids[2:]
    ordered = np.sort(windows)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: none."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    blanks = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    return len(words), len(text) - blanks, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeated_words(words)


class Fertility:
    """Token figures of texts by a sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.memo: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Token ids (int32) of the words, each encoded on its own."""
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) > MEMO_WORDS:
                memo.clear()
                new = list(set(words))
            for w, own in zip(new, self.model.encode([w.decode() for w in new], num_threads=1), strict=True):
                memo[w] = np.array(own, np.int32).tobytes()
        return list(map(memo.__getitem__, words))

    def __call__(self, text: str | None, word_chars: int) -> tuple[int, int, int, int]:
        """Number of tokens and the three figures in steps, each at most the greatest value; no token: zeros.

        The figures leave out the ODD_WORDS words of most tokens (ties: the first), unless there are no others.
        """
        words = (text or "").encode().split()
        encoded = self.ids(words)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        every = int(sizes.sum()) // 4
        if not every:
            return 0, 0, 0, 0
        if len(words) > ODD_WORDS:
            odd = np.argsort(-sizes, kind="stable")[:ODD_WORDS].tolist()
            if int(sizes[odd].sum()) < 4 * every:
                for i in odd:
                    word_chars -= len(words[i].decode())
                    encoded[i] = b""
        ids = np.frombuffer(b"".join(encoded), np.int32)
        n = len(ids)
        counts = np.unique(ids, return_counts=True)[1]
        entropy = float(-(counts / n * np.log2(counts / n)).sum() / np.log2(n)) if n > 1 else 1.0
        figures = (word_chars / n, self.is_byte[ids].sum() / n, entropy)
        return every, *(min(most, int(x * steps + 0.5)) for x, (steps, most, *_) in zip(figures, FIGURES.values(), strict=True))


_models: dict[str, Fertility] = {}


def fertility(path: str) -> Fertility:
    """The model of this Python worker for a file."""
    if path not in _models:
        _models[path] = Fertility(path)
    return _models[path]


MEASURED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_tokens": "long"} | {k: "long" for k in FIGURES}


def measure(docs: DataFrame, model: str, text: str = "text", lang: str | None = "lang", prefix: str = "") -> DataFrame:
    """docs with the counts of MEASURED, band_key and band_script, all named with the prefix; columns of those names are replaced. One pass, no shuffle."""
    names = {prefix + k: v for k, v in MEASURED.items()} | {prefix + "band_key": "string", prefix + "band_script": "string"}
    kept = docs.drop(*names)
    at, lang_at = kept.columns.index(text), kept.columns.index(lang) if lang and lang in kept.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fertility(model)
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column(at).to_pylist()
                langs = piece.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
                rows = []
                for t, name in zip(texts, langs, strict=True):
                    n_words, chars, *rest, repeated = base_counts(t)
                    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
                    of_script = f"script:{script(t or '')}"
                    rows.append((n_words, chars, *rest, repeated, failed, *own(t, chars), str(name) if name is not None else of_script, of_script))
                columns = [pa.array(x, pa.bool_() if kind == "boolean" else pa.string() if kind == "string" else pa.int64()) for x, kind in zip(zip(*rows, strict=True), names.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, *names])

    return kept.mapInArrow(run, extended(kept.schema, **names))


def _median(counted: DataFrame, value: str, out: str) -> DataFrame:
    """The lower median of value, counted n times, for each band_key and figure; a key has no more rows than a figure has steps."""
    by = Window.partitionBy("band_key", "figure")
    upto = F.sum("n").over(by.orderBy(value))
    return counted.withColumns({"upto": upto, "all": F.sum("n").over(by)}).filter(F.col("upto") * 2 >= F.col("all")).groupBy("band_key", "figure").agg(F.min(value).alias(out), F.first("all").alias("docs"))


def fit_bands(measured: DataFrame, prefix: str = "", keys: Column | None = None) -> DataFrame:
    """Rows (band_key, low and high of each figure in steps) from all documents that pass the base rules; keys: an array of keys to use for band_key."""
    if keys is not None:
        measured = measured.filter(~F.col(prefix + "base_failed")).withColumn(prefix + "band_key", F.explode(keys))
    figures = F.array(*(F.struct(F.lit(k).alias("figure"), F.col(prefix + k).alias("value")) for k in FIGURES))
    counted = (
        measured.filter(~F.col(prefix + "base_failed")).select(F.col(prefix + "band_key").alias("band_key"), F.inline(figures)).groupBy("band_key", "figure", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    middle = _median(counted, "value", "middle")
    off = counted.join(middle, ["band_key", "figure"]).groupBy("band_key", "figure", F.abs(F.col("value") - F.col("middle")).alias("off")).agg(F.sum("n").alias("n"))
    bands = middle.join(_median(off, "off", "mad").drop("docs"), ["band_key", "figure"]).filter(F.col("docs") >= LEAST_DOCS)

    def edge(figure: str, sign: int) -> Column:
        half = F.greatest(F.lit(FIGURES[figure][2]), F.col("mad") * FIGURES[figure][3])
        return F.max(F.when(F.col("figure") == figure, F.col("middle") + sign * half))

    return bands.groupBy("band_key").agg(*(edge(k, s).alias(f"__{k}_{name}") for k in FIGURES for s, name in ((-1, "low"), (1, "high"))))


def _keys(prefix: str) -> Column:
    """The keys of a document's bands, that of choice first."""
    length = F.floor(F.log2(F.greatest(F.col(prefix + "n_tokens"), F.lit(1)).cast("double")) * 2).cast("string")
    groups = (F.concat(F.lit(":"), F.col(prefix + "band_key")), F.concat(F.lit(":all of "), F.col(prefix + "band_script")), F.lit(":all"))
    return F.array(*(F.concat(F.lit(f"{k} "), at, g) for k, g in enumerate(groups) for at in (length, F.lit("any"))))


def _verdict(measured: DataFrame, prefix: str) -> DataFrame:
    """measured with __kept: by the first of its bands that enough documents have made; where none has, by the base rules alone."""
    measured = measured.withColumn("__keys", _keys(prefix))
    bands = fit_bands(measured, prefix, F.col("__keys"))
    edges = [c for c in bands.columns if c != "band_key"]
    wanted = measured.filter(~F.col(prefix + "base_failed")).select(F.col("__keys").alias("__band")).distinct().select("__band", F.posexplode("__band").alias("level", "band_key"))
    chosen = wanted.join(bands, "band_key").groupBy("__band").agg(F.min_by(F.struct(*edges), "level").alias("e")).select("__band", "e.*")
    chosen = stash(chosen, "bands")
    if chosen.count() <= BROADCAST_BANDS:
        chosen = F.broadcast(chosen)
    inside = F.lit(True)
    for k in FIGURES:
        inside = inside & F.coalesce(F.col(prefix + k).between(F.col(f"__{k}_low"), F.col(f"__{k}_high")), F.lit(True))
    joined = measured.join(chosen, F.col("__keys") == F.col("__band"), "left")
    return joined.withColumn("__kept", ~F.col(prefix + "base_failed") & inside)


def judge(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, figures), one per input row.

    A null or empty text has no words and fails. A null lang is judged by the
    text's script. Repeated rows give repeated rows; extra columns are left
    out; an empty table gives no rows.
    """
    keyed = keyed_text(docs, doc_id, text)
    if lang and lang in docs.columns:
        keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    measured = stash(measure(keyed, model).drop("text", "lang"), "quality")
    figures = [(F.col(k) / steps).alias(k) for k, (steps, *_) in FIGURES.items()]
    return _verdict(measured, "").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("__kept").alias("kept"), "n_tokens", *figures, "band_key")


def keep_good(docs: DataFrame, model: str, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of docs, with their columns, that ``judge`` keeps. The texts are written once, measured, to the shared folder.

    Null and empty texts go; a null id makes no difference, a null lang means the
    script's bands; of repeated rows all stay or all go; an empty table gives no rows.
    """
    measured = stash(measure(docs, model, text, lang, "__q_"), "quality")
    return _verdict(measured, "__q_").filter("__kept").select(*docs.columns)
