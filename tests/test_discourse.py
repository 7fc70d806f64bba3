"""Discourse operators and further scores on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import discourse, metrics, signals, store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sentences(spark):
    df = spark.createDataFrame([(1, "One two. Three, because four!\nFive。Six"), (2, None), (3, " ")], "doc_id int, text string")
    s = discourse.sentences(df)
    assert rows(s, "idx", "text") == [(0, "One two."), (1, "Three, because four!"), (2, "Five。"), (3, "Six")]
    assert discourse.clauses(s).filter("idx = 1").count() == 2
    q = lambda t: spark.range(1).select(discourse.quantifier(F.lit(t)).alias("x")).first().x
    assert (q("saw every "), q("about"), q("the")) == ("universal", "approximate", None)


def test_centering(spark):
    data = [(1, 1, ["john", "store"]), (1, 2, ["john"]), (1, 3, ["mary", "john"]), (1, 4, ["mary"]), (1, 5, ["sky"])]
    got = discourse.centering(spark.createDataFrame(data, "d int, k int, c array<string>"), "d", "k", "c").orderBy("k").collect()
    assert [r.transition for r in got] == [None, "continue", "retain", "smooth_shift", None]
    one = discourse.coherence(discourse.centering(spark.createDataFrame(data, "d int, k int, c array<string>"), "d", "k", "c"), "d").first()
    assert (one["continue"], one.retain, one.smooth_shift, one.rough_shift) == (1, 1, 1, 0)


def test_resolution(spark):
    data = [(1, 0, "Anna Schmidt", "PER"), (1, 1, "European Central Bank", "ORG"), (1, 2, "Schmidt", "PER"), (1, 3, "ECB", "ORG"), (1, 4, "she", "PRON"), (1, 5, "Paris", "LOC"), (1, 6, "it", "PRON")]
    got = rows(discourse.resolve(spark.createDataFrame(data, "doc_id int, idx int, text string, type string")), "idx", "chain")
    assert got == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 5), (6, 1)]


def test_events_are_not_transitive(spark):
    data = [(1, 0, "hit", "A", ["a", "b"]), (1, 1, "strike", "A", ["b", "c"]), (1, 2, "blow", "A", ["c", "d"]), (1, 3, "hit", "B", ["a"])]
    got = rows(discourse.event_clusters(spark.createDataFrame(data, "doc_id int, idx int, trigger string, type string, args array<string>")), "idx", "cluster")
    assert got == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_tag_model(spark):
    data = [(1, 0, "Anna", "B"), (1, 1, "runs", "O"), (2, 0, "Anna", "B"), (2, 1, "sings", "O")]
    df = spark.createDataFrame(data, "d int, k int, w string, t string")
    tr, em = discourse.tag_counts(df, "d", "k", "w", "t")
    assert rows(tr, "prev", "tag", "n") == [("B", "O", 2), ("START", "B", 2)]
    logs = lambda r, *k: {tuple(x[c] for c in k): math.log(x["n"] / 2) for x in r.collect()}
    got = discourse.decode_tags(df, logs(tr, "prev", "tag"), logs(em, "tag", "token"), "d", "k", "w")
    assert rows(got, "d", "k", "tag") == [(1, 0, "B"), (1, 1, "O"), (2, 0, "B"), (2, 1, "O")]


def test_scores(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    r = metrics.one_to_one(a, b, ["k"]).first()
    assert (r.hit, r.precision, r.recall) == (1, 0.5, pytest.approx(1 / 3))
    assert metrics.one_to_one(a.limit(0), b.limit(0), ["k"]).first().f1 == 1
    c = metrics.compare(a, b, ["k"]).first()
    assert (c.jaccard, c.unchanged, c.added, c.removed) == (pytest.approx(1 / 3), 1, 1, 2)
    assert metrics.compare(a.limit(0), b.limit(0), ["k"]).first().jaccard == 1


def test_signals_and_store(spark):
    docs = spark.createDataFrame([(1, "abc def")], "doc_id int, text string")
    ents = spark.createDataFrame([(1, "abc", 0, 3, 0.5), (1, "xyz", 4, 7, 2.0), (1, "", 5, 5, 0.1), (2, "q", 0, 1, 0.1)], "doc_id int, text string, start int, end int, confidence double")
    got = sorted(r.issues for r in signals.validate_entities(ents, docs).collect())
    assert got == [[], ["empty text", "inverted span"], ["no document"], ["text mismatch", "confidence"]]
    assert signals.legal_filter() is None and signals.information_loss({"a": "X", "b": "X", "c": "Y"}) == {"X": ["a", "b"]}
    chunks = spark.createDataFrame([(1, "C:\\Docs\\a\\x"), (2, "/docs/ab"), (3, None)], "doc_id int, source_path string")
    kept, went = store.delete_folder(chunks, "c:/docs/a")
    assert rows(kept, "doc_id") == [(2,), (3,)] and tuple(went.first()) == (1, 1, 1)
    roots = spark.createDataFrame([("a", "/x/y"), ("b", "/z")], "corpus_id string, root string")
    assert rows(store.overlapping_roots(roots, "/x"), "corpus_id") == [("a",)] and rows(store.overlapping_roots(roots, "/x/y/w/"), "corpus_id") == [("a",)]
    jobs = spark.createDataFrame([(1, "queued"), (2, "done")], "job_id int, status string")
    assert rows(store.transition(jobs, "running", {"queued": {"running"}}, jobs), "job_id", "status") == [(1, "running"), (2, "done")]


def test_resolve_takes_nulls_blanks_ties_and_long_documents(spark):
    schema = "doc_id int, idx int, text string, type string"
    data = [(1, 0, None, "PER"), (1, 1, "  ", "PER"), (1, 2, "Ann Lee", "PER"), (1, 2, "ANN LEE", None), (1, 3, "she", None), (None, 4, "Lee", "PER"), (None, 5, "ann lee", "PER"), (1, 6, "IBM", "ORG"), (1, 7, "International Business Machines", "ORG"), (1, 8, "it", "ORG"), (1, 9, "Business Machines", "ORG")]
    got = {(r.doc_id, r.idx, r.chain) for r in discourse.resolve(spark.createDataFrame(data, schema)).collect()}
    assert got == {(1, 0, 0), (1, 1, 1), (1, 2, 3), (1, 2, 2), (1, 3, 3), (None, 4, 0), (None, 5, 0), (1, 6, 5), (1, 7, 5), (1, 8, 5), (1, 9, 5)}
    many = [(1, i, f"Name{i % 40} Surname{i % 20}", "PER") for i in range(4000)]
    assert {r.chain for r in discourse.resolve(spark.createDataFrame(many, schema)).collect()} == set(range(20))
    assert discourse.resolve(spark.createDataFrame([], schema)).collect() == []


def test_event_clusters_take_nulls(spark):
    data = [(1, 0, None, "A", None), (1, 1, None, "A", ["x"]), (1, 2, "Hit", None, ["x"]), (1, 3, "hit", None, None), (None, 4, "hit", "A", ["x", None])]
    got = {(r.doc_id, r.idx): r.cluster for r in discourse.event_clusters(spark.createDataFrame(data, "doc_id int, idx int, trigger string, type string, args array<string>")).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (None, 4): 4}


def test_the_worst_risk_and_the_first_head(spark):
    from textloom.operators import reports, subjects

    rule = spark.createDataFrame([(1, "a", "low")], "doc_id int, category string, severity string")
    model = spark.createDataFrame([(1, "b", "medium"), (1, "b", "critical"), (1, "b", "odd"), (1, "a", "high"), (2, "c", None)], "doc_id int, category string, severity string")
    assert {tuple(r) for r in subjects.merge_risks(rule, model).collect()} == {(1, "a", "low", "rule"), (1, "b", "critical", "model"), (2, "c", None, "model")}
    m = [("gold", 1, 0, 0, 5, 4, 5), ("gold", 1, 1, 3, 5, 4, 5), ("pred", 1, 7, 0, 5, 4, 5), ("gold", 1, 0, 8, 9, 8, 9), ("pred", 1, 7, 8, 9, 8, 9)]
    assert reports.b_cubed_heads(spark.createDataFrame(m, "side string, doc_id int, chain_id int, start int, end int, head_start int, head_end int")).first().f1 == 1
