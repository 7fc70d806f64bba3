"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash as S
from textloom.llm.components import connected_components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(ids, fps, tau):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


TEXTS = ["", None, "one", "One two", "a b c", "A  B\tC", "a b c d", " x\x0by z w " * 30, "É é ÉÉ é" * 9, "  nbsp stays word", "🙂 🙂 🙂 🙂"]


def test_fingerprint_is_brute_force():
    for t in TEXTS + ["the cat sat on the mat " * 500]:
        assert S.simhash(t) == brute_fp(t)


def test_blocks_do_not_change_it(monkeypatch):
    t = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    whole = S.simhash(t)
    monkeypatch.setattr(S, "BLOCK_WORDS", 7)
    monkeypatch.setattr(S, "BLOCK_BYTES", 11)
    assert S.simhash(t) == whole == brute_fp(t)
    assert S.simhash("ab " * 3 + " " * 40) == brute_fp("ab ab ab")


@pytest.mark.parametrize("hot", [2, 8, 10**6])
def test_near_pairs_are_all_pairs(spark, hot):
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**63, 12):
        for _ in range(14):
            f = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
            fps.add(f - 2**64 if f >= 2**63 else f)
    fps |= {0, -1, 1, 3}
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = S.near_pairs(spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long"), 2, hot).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_thresholds_sum_and_cost():
    cost, ts = S.allocate([[0, 5, 6, 9], [0, 1, 50, 90], [0, 2, 3, 4]], 0)
    assert sum(ts) == 0 and cost == min(
        a[x + 1] + b[y + 1] + c[z + 1] for a, b, c in [([0, 5, 6, 9], [0, 1, 50, 90], [0, 2, 3, 4])] for x in range(-1, 3) for y in range(-1, 3) for z in range(-1, 3) if x + y + z == 0
    )
    groups = S.group_bits(0, np.zeros((64, 64)), 3)
    assert sorted(sum(groups, [])) == list(range(64))


def test_near_duplicates(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
    rows = [(5, base), (3, base), (9, base + "lambda"), (7, "quite another text of words"), (None, base), (None, None), (None, ""), (7, "quite another text of words")]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = S.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(map(str, zip([a for a, _ in rows], [f"{f:016x}" for f in fps], brute_roots([a for a, _ in rows], fps, 2), strict=True)))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7000), (7000, 200), (5, 5), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 7000: 100, 200: 100, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
