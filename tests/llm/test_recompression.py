"""Recompression: anchors depend on a window's words alone; what is removed equals brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import recompression

SCHEMA = "doc_id long, text string, words string, name int"


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) of each row, by a table of all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed, vocabulary, documents):
    r = random.Random(seed)
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 40))) for _ in range(5)]
    return [" ".join([r.choice(pool), *(r.choice(vocabulary) for _ in range(r.randrange(6))), r.choice(pool)]) for _ in range(documents)]


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows_have_equal_anchors(seed, monkeypatch):
    monkeypatch.setattr(recompression, "PIECE", (41, 1 << 16)[seed % 2])
    window = (5, 12, 50)[seed % 3]
    texts = passages(seed, [chr(97 + k) * (1 + 300 * (k == 3)) for k in range((1, 2, 4, 20)[seed % 4])], 40)
    words = recompression.Words(pa.array(texts))
    at, name, _ = recompression.anchors(words.lanes[0], window)
    own = np.searchsorted(words.offset, at, side="right") - 1
    seen = {}
    for a, n, k in zip(at, name, own):
        key = tuple(texts[k].split()[a - words.offset[k] :][:window])
        assert len(key) == window and seen.setdefault(key, n) == n
    assert len(at) == sum(max(0, len(t.split()) - window + 1) for t in texts)


@pytest.mark.parametrize("seed", range(4))
def test_removed_words_equal_brute_force(spark, seed):
    window = (6, 9, 6, 15)[seed]
    texts = passages(seed, list("abcdefghijklmnopqrstuvwxyz"[: (1, 3, 8, 26)[seed]]), 60)
    r = random.Random(seed)
    rows = [(r.choice([None, *range(40)]), r.choice([t, t.replace(" ", "\n \t"), f"  {t} "])) for t in texts]
    rows += [(7, None), (None, None), (8, ""), (9, " \n"), rows[0], rows[0], (3, rows[1][1]), (10, "é " * window), (11, "é " * (window + 3)), (12, "  " * window)]
    found = recompression.repeats(spark.createDataFrame([(*row, "x", k) for k, row in enumerate(rows)], SCHEMA), window=window).collect()
    got = []
    for row in found:
        gone = sum(s["length"] for s in row["spans"] or [])
        kept = row["digest"] if row["kept"] is None else hashlib.sha256(row["kept"].encode()).hexdigest()
        got.append((row["doc_id"], row["n_words"], gone, kept))
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows, window), key=order)


def test_one_passage_in_many_documents(spark):
    """A passage of all documents makes one class inside and is not paired off."""
    r = random.Random(5)
    passage = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*(f"a{r.random()}" for _ in range(9)), *passage, *(f"b{r.random()}" for _ in range(i % 7))])) for i in range(300)]
    found = {x["doc_id"]: x for x in recompression.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["spans"] is None
    assert all([tuple(s) for s in found[i]["spans"]] == [(9, 80)] for i in range(1, 300))


def test_empty_table(spark):
    assert recompression.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
