"""The manifest: roots, subroots and proofs equal those of plain lists, however leaves are dealt."""

import hashlib
import random
import zlib

import pytest

from textloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves, arity):
    """(root, for each leaf its list of (left, right)) of a list of digests."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        groups = [level[k : k + arity] for k in range(0, len(level), arity)]
        for k, i in enumerate(at):
            g = groups[i // arity]
            paths[k].append(("".join(g[: i % arity]), "".join(g[i % arity + 1 :])))
        level, at = [h(*g) for g in groups], [i // arity for i in at]
    return level[0], paths


def whole(rows, arity):
    """rows (group, by, leaf) to {row: (subroot, root, path)}."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for g in names}
    made = {g: plain([x[2] for x in own[g]], arity) for g in names}
    root, above = plain([made[g][0] for g in names], arity)
    return sorted(((*row, made[g][0], root, [*path, *above[k]]) for k, g in enumerate(names) for row, path in zip(own[g], made[g][1])), key=repr)


@pytest.mark.parametrize("sizes, arity", [({None: 1, "a": 1}, 8), ({"a": 1}, 8), ({"a": 8, "b": 9, None: 65, "é": 1, "z": 7}, 8), ({"x": 300, "y": 17}, 2), ({f"g{k}": k % 4 + 1 for k in range(30)}, 3)])
def test_manifest_equals_plain_lists(spark, sizes, arity, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    r = random.Random(2)
    rows = [(g, r.choice([None, *range(n)]), h(str(r.randrange(n)))) for g, n in sizes.items() for _ in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*row, "tree", 7) for row in rows], "kind string, by long, leaf string, tree string, place int").repartition(5)
    out = merkle.manifest(df, "kind", "by", arity)
    got = sorted(((x["kind"], x["by"], x["leaf"], x["subroot"], x["root"], [tuple(p) for p in x["path"]]) for x in out.collect()), key=repr)
    assert out.columns[:5] == ["kind", "by", "leaf", "tree", "place"]
    assert got == whole(rows, arity)


def test_order_of_events_does_not_matter():
    leaves = [h(str(k)) for k in range(75)]
    want, _ = plain(leaves, 8)
    for seed in range(20):
        events = [("t", 75, 0, k, d) for k, d in enumerate(leaves)]
        random.Random(seed).shuffle(events)
        out = list(merkle.accumulate(iter(events), 8, 5 if seed % 2 else 1000))
        while any(not x[-1] for x in out):
            made = [x for x in out if x[-1]]
            out = [*made, *merkle.accumulate((x[:5] for x in out if not x[-1]), 8)]
        assert [x[4] for x in out if x[2] == merkle.height(75)] == [want] and len(out) == 10 + 2 + 1


def test_only_tampered_texts_with_capitals_fail(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", ["en", None][i % 5 == 0], "s", i) for i in range(80)] + [(None, "Null Id", "en", None, None), (4, None, "de", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.verified(docs).collect()
    assert len(out) == len(rows) and len({x["root"] for x in out}) == 1

    def written(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    of = {h(*map(written, (i, source, lang, n, text))): (i, text) for i, text, lang, source, n in rows}
    for x in out:
        i, text = of[x["leaf"]]
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None and text != text.lower()
        assert x["doc_id"] == i and x["verified"] == (not changed) == (x["folded_root"] == x["root"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.verified(docs).collect() == []
