"""Near copies against brute force over all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import nearcopies as N
from textloom.llm import simhash as S


def brute_set(t):
    words = (t or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(texts):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * same >= 4 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng):
    """Texts with a common passage, copies of them with a few words changed, and a chain of copies."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 30))
    texts = []
    for i in range(24):
        own = list(rng.choice(vocabulary, int(rng.integers(60, 160))))
        texts.append(" ".join(own) + (" " + passage if i % 2 else ""))
        for k in range(int(rng.integers(0, 5))):
            other = own.copy()
            for at in rng.integers(0, len(own), k + 1):
                other[at] = f"x{rng.integers(10**6)}"
            own = other if i % 3 == 0 else own
            texts.append(" ".join(other) + (" " + passage if i % 2 else ""))
    return texts + ["", None, "one", "One", "a b c", "a b c d e f", texts[0].upper()]


def test_all_near_copies_and_no_others(spark):
    texts = edited(np.random.default_rng(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert len(set(got.values())) < len(texts) - 20
    assert N.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 2])
def test_crowded_keys_lose_no_near_copy(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    rng = np.random.default_rng(11)
    texts = edited(rng)
    passage = " ".join(f"p{k}" for k in range(40))
    for i in range(60):  # a passage that all share, and pairs of near copies among them
        own = [f"o{i}x{k}" for k in range(12)]
        texts.append(" ".join(own) + " " + passage)
        if i % 6 == 0:
            texts.append(" ".join([*own[:-1], "end"]) + " " + passage)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_a_common_passage_is_not_paired_off(spark, monkeypatch):
    compared = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, sets: (compared.append(pairs.count()), verified(pairs, sets))[1])
    passage = " ".join(f"p{k}" for k in range(14))
    texts = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(1500)]
    assert N.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).select("component_id").distinct().count() == 1500
    assert sum(compared) < 1500 * 20


def test_copies_of_one_original_that_are_not_copies_of_each_other(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    texts = [" ".join(base)]
    for _ in range(60):  # similarity of about 0.83 to the original and 0.7 to one another
        own = base.copy()
        for at in rng.choice(300, 5, replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(own))
    order = rng.permutation(len(texts))
    df = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(df).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want and want.count(0) > 50


def test_keys_and_fingerprint_of_a_set(monkeypatch):
    own = N.shingle_set(" ".join(f"w{i}" for i in range(900)))
    keys = N.band_keys(own)
    x = own.view(np.uint64)
    least = [min(int(v) * int(m) % (1 << 64) for v in x) for m in N._ODD[: N.ROWS]]
    assert keys[0] == np.uint64(N.xxhash.xxh64_intdigest(np.array(least, np.uint64).tobytes(), seed=0)).astype(np.int64) and len(keys) == N.BANDS
    bits = [sum(int(v) >> (63 - b) & 1 for v in x) * 2 > len(x) for b in range(64)]
    assert N.set_fingerprint(own) & (1 << 64) - 1 == int("".join(map(str, map(int, bits))), 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "BLOCK_WORDS", 11)
    assert (N.band_keys(own) == keys).all() and N.set_fingerprint(own) & (1 << 64) - 1 == int("".join(map(str, map(int, bits))), 2)
    assert len(N.band_keys(own[:0])) == 0 and N.set_fingerprint(own[:0]) == 0


def test_sketches_tell_the_similarity(monkeypatch):
    a = N.shingle_set(" ".join(f"w{i}" for i in range(900)))
    for share in (0.5, 0.8, 0.95):
        k = int(round(len(a) * (1 - share) / (1 + share)))  # gone from a and as many new: a similarity of share
        b = np.sort(np.concatenate([a[k:], N.shingle_set(" ".join(f"v{i}" for i in range(k + 4)))]))
        differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in N.sketch(a) ^ N.sketch(b))
        assert abs(1 - 2 * differ / N.SKETCH - share) < 0.08
    whole = N.sketch(a).tolist()
    monkeypatch.setattr(N, "BLOCK", 7)
    assert N.sketch(a).tolist() == whole and 125 < N.MOST_DIFFERENT < 135


def test_stage_drops_edited_copy(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 500, 200)]
    copy = words.copy()
    for at in (20, 90, 150):
        copy[at] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3}


def test_set_in_blocks(monkeypatch):
    t = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    whole = N.shingle_set(t)
    assert len(whole) == len(brute_set(t))
    monkeypatch.setattr(N, "BLOCK_WORDS", 7)
    monkeypatch.setattr("textloom.llm.simhash.BLOCK_BYTES", 11)
    assert (N.shingle_set(t) == whole).all()


@pytest.mark.parametrize("keep", [N.first_of_each, S.first_of_each])
def test_unlike_texts_of_one_id_both_stay(spark, keep):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (0, c), (2, b), (1, a), (None, a), (None, "d e f g h i"), (None, "d e f g h i"), (3, None), (4, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS __id", "text AS fp")
    got = keep(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", a), ("1", b), ("0", c), ("None", "d e f g h i"), ("3", "None")])
