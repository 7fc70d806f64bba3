"""Periodic runs: every run equals brute force, whether lags are one range or several."""

import hashlib
import random
import zlib

import pytest

from textloom.llm import periods


def brute(words):
    """Runs by trying every stretch of every lag and every smaller period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            long = j > i and j - i + q >= max(6, 4 * q)
            if long and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def without(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repeating(r):
    words = [r.choice("abc"[: r.choice([1, 2, 3])]) for _ in range(r.randrange(0, 40))]
    return words + words[-r.randrange(1, 6) :] * r.randrange(0, 6) + words[:5]


def test_runs_of_random_words():
    for seed in range(1500):
        words = repeating(random.Random(seed))
        assert [tuple(map(int, x)) for x in periods.runs(words)] == brute(words)


@pytest.mark.parametrize("narrow, size", [(1 << 16, 1 << 29), (20, 60), (0, 1)])
def test_ranges_of_lags_give_the_same_runs(spark, narrow, size):
    r = random.Random(3)
    texts = ["\t".join(repeating(r)) for _ in range(40)]
    texts += [None, "", " \n ", texts[0], "x", "É é " * 12, "a b " * 6, "long" * 50 + " " + "w " * 30]
    rows = [(k % 45 if k % 9 else None, t, "clash", k) for k, t in enumerate(texts)]
    out = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, `odd.name` int"), narrow=narrow, size=size).collect()
    assert len(out) == len(rows)
    for row in out:
        words = periods.WORD.findall(texts[row["odd.name"]] or "")
        assert [tuple(x) for x in row["runs"]] == brute(words) and row["collapsed"] == without(words, brute(words))


def test_report_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, " ".join(repeating(r))) for i in range(200)] + [(None, "a " * 9), (3, None), (35, ""), (35, "a b"), (35, "a b")]
    got = periods.run_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute(words)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
        written = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(without(words, found).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert periods.run_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
