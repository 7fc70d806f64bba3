"""Operators on small hand-made frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunks, coref, drift, graph, history, memory, pii, retrieval, sampling, scoring, spans, tabular
from textloom.sources import exports, readers
from textloom.streaming import buffers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_overlap_join_is_all_overlaps(spark):
    rng = random.Random(1)
    table = [(rng.randint(0, 2), i, s := rng.randint(0, 300), s + rng.randint(1, 150)) for i in range(120)]
    df = spark.createDataFrame(table, "k int, id int, start int, end int")
    want = sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(table, 2) if a[0] == b[0] and a[2] < b[3] and a[3] > b[2])
    assert rows(spans.self_overlaps(df, ["k"], "id", width=16), "k", "id", "id_r") == want
    inside = sorted((a[1], b[1]) for a in table for b in table if a[0] == b[0] and a[2] <= b[2] and a[3] >= b[3])
    assert rows(spans.containing_join(df, df, ["k"]), "id", "id_r") == inside


SPANS = [(1, 0, 5, "A", 0.5), (1, 3, 9, "A", 0.9), (1, 4, 6, "B", 0.7), (1, 9, 12, "A", 0.1), (2, 0, 1, "A", 0.2)]


@pytest.mark.parametrize(("strategy", "want"), [("first", [(0, 5), (0, 1), (9, 12)]), ("confidence", [(3, 9), (0, 1), (9, 12)]), ("shortest", [(4, 6), (0, 1), (9, 12)]), ("longer_same_type", [(3, 9), (4, 6), (0, 1), (9, 12)])])
def test_dedup(spark, strategy, want):
    df = spark.createDataFrame(SPANS, "k int, start int, end int, label string, confidence double")
    assert rows(spans.dedup_overlapping(df, ["k"], strategy), "start", "end") == sorted(want)


def test_merge_and_greedy(spark):
    df = spark.createDataFrame(SPANS, "k int, start int, end int, label string, confidence double")
    assert rows(spans.merge_overlapping(df, ["k"], "label"), "k", "start", "end") == [(1, 0, 9), (1, 9, 12), (2, 0, 1)]
    kept = df.groupBy("k").agg(spans.greedy_nonoverlap(F.collect_list(F.struct("start", "end"))).alias("x")).select("k", F.inline("x"))
    assert rows(kept, "k", "start", "end") == [(1, 0, 5), (1, 9, 12), (2, 0, 1)]


def test_gold_matching(spark):
    gold = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "B"), (1, 20, 25, "A"), (2, 0, 3, "A")], "d int, start int, end int, label string")
    pred = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "C"), (1, 22, 30, "A"), (3, 0, 1, "A")], "d int, start int, end int, label string")
    m = spans.match_gold(gold, pred, "d")
    assert sorted(r["class"] for r in m.collect()) == ["exact", "exact_boundary", "none", "partial", "spurious"]
    s = spans.match_scores(m).first()
    assert (s.precision_exact, s.recall_exact, s.precision_overlap, s.recall_overlap) == (0.25, 0.25, 0.75, 0.75)


def test_bio_round_trip(spark):
    tags = ["B-A", "I-A", "O", "I-B", "B-B", "I-A"]
    df = spark.createDataFrame([(1, i, f"t{i}", t) for i, t in enumerate(tags)], "d int, pos int, tok string, tag string")
    got = rows(spans.bio_spans(df, "d", "pos", "tok", "tag"), "start", "end", "label", "text")
    assert got == [(0, 2, "A", "t0 t1"), (3, 4, "B", "t3"), (4, 5, "B", "t4"), (5, 6, "A", "t5")]


def mentions(spark, gold, pred):
    out = [(side, 1, c, m, m + 1) for side, chains in (("gold", gold), ("pred", pred)) for c, ms in enumerate(chains) for m in ms]
    return spark.createDataFrame(out, "side string, doc_id int, chain_id int, start int, end int")


def test_coref(spark):
    same = mentions(spark, [[1, 2, 3], [4]], [[4], [1, 2, 3]])
    for f in (coref.muc, coref.b_cubed, coref.ceaf, coref.lea, coref.blanc, coref.cross_document_b_cubed):
        r = f(same).first()
        assert (r.precision, r.recall, r.f1) == pytest.approx((1, 1, 1)), f.__name__
    assert coref.conll(same).first().f1 == pytest.approx(1)
    split = mentions(spark, [[1, 2, 3, 4]], [[1, 2], [3, 4]])
    assert tuple(coref.muc(split).first())[:2] == pytest.approx((1, 2 / 3))
    assert tuple(coref.b_cubed(split).first())[:2] == pytest.approx((1, 0.5))
    assert tuple(coref.ceaf(split, 3).first())[:2] == pytest.approx((0.5, 0.5))
    assert tuple(coref.lea(split).first())[:2] == pytest.approx((1, 1 / 3))
    one = mentions(spark, [[1]], [[1]])
    assert coref.blanc(one).first().f1 == 1 and coref.muc(one).first().f1 == 0
    wide = mentions(spark, [[1, 2]], [[1, 2], [3, 4]])
    assert coref.cross_document_b_cubed(wide).first().precision == pytest.approx(0.5)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, False), (1.0, True), (0.95, True), (0.1, False)], "c double, y boolean")
    assert rows(scoring.calibration_bins(df, "c", "y"), "bin", "n") == [(0, 1), (1, 1), (9, 2)]
    empty = scoring.calibration(df.limit(0), "c", "y").first()
    assert (empty.ece, empty.mce, empty.brier) == (0, 0, 0)
    curve = scoring.threshold_curve(df, "c", "y", 10).orderBy("threshold").collect()
    assert len(curve) == 11 and curve[0].recall == 1 and curve[-1].precision == 1
    assert scoring.imbalance(df.limit(0), "y").first().ratio == 1


def test_retrieval_scores(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("z", "c", 0)], "query string, doc string, grade int")
    hits = spark.createDataFrame([("q", "x", 0), ("q", "a", 1)], "query string, doc string, rank int")
    got = {r["query"]: r for r in scoring.retrieval_scores(hits, qrels, 2).collect()}
    assert got["q"].recall == 0.5 and got["z"].recall == got["z"].ndcg == 1
    import math

    assert got["q"].ndcg == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)))


def test_paired_t_steps(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 41)], "a double, b double")
    assert history.paired_t(df, "a", "b").first().p == 0.01
    assert history.paired_t(df.limit(1), "a", "b").first().p == 1


def test_drift(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",)], "k string")
    import math

    assert drift.kl_divergence(a, b, "k").first().kl == pytest.approx(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3 / 1e-10))
    assert drift.js_divergence(a, a, "k").first().js == 0 and 0 < drift.js_divergence(a, b, "k").first().js < 1
    assert drift.vocabulary_drift(a, b.limit(0), "k").first().drift == 0 and drift.vocabulary_drift(a, b, "k").first().drift == 0.5


def test_memory(spark):
    schema = "id int, session string, kind string, created_at int, valid_from int, valid_to int, entity_refs array<string>, embedding array<double>"
    m = spark.createDataFrame([(1, None, "preference", 1, 1, None, ["a"], [1.0, 0.0]), (2, "s", "preference", 2, 2, 5, ["a", "b"], [1.0, 0.1]), (3, "t", "fact", 3, 3, None, ["b", "c"], [0.0, 1.0])], schema)
    assert rows(m.filter(memory.valid_at(F.lit(5))), "id") == [(1,), (3,)]
    assert rows(memory.conflicts(m), "id", "prior") == [(2, 1)]
    assert rows(memory.invalidate(m, m.filter("id < 3").select("id"), F.lit(9)), "id", "valid_to")[:2] == [(1, 9), (2, 5)]
    assert rows(memory.graph_recall(m, ["a"], F.lit(4)), "entity", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    left, tokens = memory.forget(m, spark.createDataFrame([("a",), ("b",), ("c",)], "token string"), m.filter("id = 3").select("id"))
    assert left.count() == 2 and rows(tokens, "token") == [("a",), ("b",)]
    assert memory.recall(m.withColumn("score", F.lit(1.0)), None, "s", F.lit(3), 1).count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "from_id string, to_id string").withColumn("type", F.lit("APPEALS"))
    assert [r.path for r in graph.appeal_chain(edges, "a", 3).orderBy("depth").collect()] == ["a", "a>b", "a>b>a", "a>b>a>b"]
    old = spark.createDataFrame([("L", "1", "x")], "label string, id string, props string")
    new = spark.createDataFrame([("L", "1", "y"), ("L", "2", "z"), ("L", "2", "z")], "label string, id string, props string")
    assert rows(graph.graph_upsert(old, new, ["label", "id"]), "id", "props") == [("1", "y"), ("2", "z")]


def test_tabular(spark):
    schema = "row_id int, col_id int, version int, value_json string, locked boolean, author string"
    cells = spark.createDataFrame([(1, 1, 1, '"a"', False, "u"), (1, 1, 2, '"b"', True, "u"), (1, 2, 1, "null", False, "u")], schema)
    new = spark.createDataFrame([(1, 1, '"c"', False, "system"), (1, 2, '"d"', False, "system"), (2, 1, '"e"', False, "u")], "row_id int, col_id int, value_json string, locked boolean, author string")
    kept, refused = tabular.append_version(cells, new)
    assert rows(tabular.latest(kept), "row_id", "col_id", "version") == [(1, 1, 2), (1, 2, 2), (2, 1, 1)] and refused.count() == 1
    lit = lambda kind, v, x=None: spark.range(1).select(tabular.condition(kind, F.lit(v).cast("string"), x).alias("y")).first().y
    assert lit("not_equals", None, "1") and not lit("equals", None, "1") and not lit("non_null", "null") and lit("matches", '"ab"', "^a") and not lit("matches", "12", "1")
    assert tabular.waves({"c": (3, "b"), "b": (2, "a"), "a": (1, None), "z": (0, "missing")}) == [["z", "a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        tabular.waves({"a": (1, "b"), "b": (2, "a")})
    assert tabular.batches([("a", 5), ("b", 6), ("c", 4), ("d", 99)], 10) == [["a"], ["b", "c"], ["d"]]
    text = spark.createDataFrame([(1, "aébc")], "chunk_id int, text string")
    cites = [(1, 0, 3, "aé"), (1, 0, 2, "a"), (1, 3, 1, ""), (1, 0, 99, ""), (2, 0, 1, ""), (1, 0, 1, "b")]
    got = [r.outcome for r in tabular.verify_citations(spark.createDataFrame(cites, "chunk_id int, start int, end int, quote string"), text).collect()]
    assert sorted(got) == sorted(["ok", "split_character", "inverted", "out_of_bounds", "unknown_chunk", "mismatch"])


def test_pii(spark):
    t = "Mail a@b.com or c@d.org, SSN 123-45-6789."
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id int, text string").withColumn("s", pii.scan(F.col("text")))
    got = {r.doc_id: r for r in df.select("doc_id", pii.redact(F.col("text"), F.col("s")).alias("r"), pii.mask(F.col("text"), F.col("s")).alias("m")).collect()}
    assert got[1].r == "Mail [CONTACT_2] or [CONTACT_1], SSN [ID_NUMBER_1]." and len(got[1].m) == len(t) and got[2].r is None and got[3].r == ""
    found = df.select("doc_id", F.explode("s").alias("x")).select("doc_id", "x.*")
    assert pii.report(found).first().risk == "CRITICAL"
    vault = pii.vault_tokens(found, spark.createDataFrame([("CONTACT", "z@z.zz", "CONTACT_4")], "type string, text string, token string"))
    assert rows(vault, "text", "token") == [("123-45-6789", "ID_NUMBER_1"), ("a@b.com", "CONTACT_5"), ("c@d.org", "CONTACT_6"), ("z@z.zz", "CONTACT_4")]
    back = pii.rehydrate(spark.createDataFrame([(1, "to CONTACT_5, CONTACT_55 and ID_NUMBER_1.")], "doc_id int, text string"), vault).first()
    assert back.text == "to a@b.com, CONTACT_55 and 123-45-6789."


def test_chunks():
    t = "One two. Three four five! " * 30 + "x" * 500
    cuts = chunks.chunk_text(t, 100, 20)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert chunks.chunk_text("", 10, 2) == [] and chunks.chunk_text("short", 10, 2) == [(0, 5)]
    assert chunks.chunk_text("a b c d", 4, 0, sentences=False) == [(0, 4), (4, 7)]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(90)], "id int, s string")
    assert rows(sampling.hash_sample(df.repartition(7), ["id"], 10), "id") == rows(sampling.hash_sample(df.coalesce(1), ["id"], 10), "id")
    got = sampling.stratified_sample(df, "s", ["id"], 9).groupBy("s").count()
    assert rows(got, "s", "count") == [("a", 6), ("b", 3)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "cat")], "doc_id int, text string")
    q = spark.createDataFrame([("q", ["red", "dog"])], "query string, terms array<string>")
    top = retrieval.keyword_arm(docs, q, 5).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [2, 1]
    assert [r.doc_id for r in retrieval.fuse([retrieval.keyword_arm(docs, q, 5), retrieval.trigram_arm(docs, q, 5)], "doc_id", 2).orderBy("rank").collect()] == [2, 1]
    pages, last, seen = spark.range(10).select(F.col("id"), (F.col("id") % 3).alias("v")), None, []
    while page := retrieval.keyset_page(pages, 4, "v", "id", last).collect():
        seen += [r.id for r in page]
        last = (page[-1].v, page[-1].id)
    assert sorted(seen) == list(range(10)) and len(seen) == 10
    path = lambda p: spark.range(1).select(retrieval.under_folder(F.lit(p), "C:\\Docs\\A").alias("x")).first().x
    assert path("c:/docs/a/x.txt") and path("C:\\docs\\a") and not path("c:/docs/ab")


def test_readers(spark, tmp_path):
    (tmp_path / "a.conll").write_text("-DOCSTART- O\n\nAnna B-PER\nruns O\n\nParis B-LOC\n")
    got = readers.read("conll", spark, str(tmp_path / "a.conll"))
    assert rows(got, "sentence", "position", "token", "tag") == [(1, 1, "Anna", "B-PER"), (1, 2, "runs", "O"), (2, 1, "Paris", "B-LOC")]
    (tmp_path / "a.jsonl").write_text('{"tokens": ["a", "b"], "ner_tags": [0, 5]}\n')
    assert rows(readers.read("wikiann", spark, str(tmp_path / "a.jsonl")), "position", "tag") == [(1, "O"), (2, "B-LOC")]
    (tmp_path / "a.ann").write_text("T1\tPER 0 4\tAnna\nR1\tx Arg1:T1\nT2\tLOC 5 7;9 10\tPa s\n")
    assert rows(readers.read("brat", spark, str(tmp_path / "a.ann")), "id", "start", "end", "text") == [("T1", 0, 4, "Anna"), ("T2", 5, 10, "Pa s")]
    (tmp_path / "a.nt").write_text('<urn:a> <urn:p> "x y"@en .\n<urn:a> <urn:q> <urn:b> .\n# no\n')
    assert rows(readers.read("n_triples", spark, str(tmp_path / "a.nt")), "predicate", "object") == [("urn:p", "x y"), ("urn:q", "urn:b")]
    (tmp_path / "t").write_text("LOC:city Where is Rome ?\n")
    assert rows(readers.read("trec", spark, str(tmp_path / "t")), "label", "text") == [("LOC", "Where is Rome ?")]
    (tmp_path / "r.json").write_text('{"rows": [{"row": {"text": "a", "label": 1}}, {"row": {"text": "b", "label": 2}}]}')
    assert rows(readers.read("rows_api", spark, str(tmp_path / "r.json"), row="text:string,label:int"), "text", "label") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        readers.read("nothing", spark, "x")
    folder = tmp_path / "in"
    (folder / "anon").mkdir(parents=True)
    for name, size in (("a.txt", 5), ("b.txt", 50), ("c.md", 5), ("d.exe", 1), ("anon/e.txt", 1)):
        (folder / name).write_text("x" * size)
    found = readers.discover(spark, str(folder), 10, 20)
    assert [r.path.rsplit("/", 1)[-1] for r in found.orderBy("path").collect()] == ["a.txt", "c.md"]
    assert tuple(readers.count_candidates(spark, str(folder)).first()) == (3, 60)
    assert tuple(readers.count_candidates(spark, str(tmp_path), str(folder)).first())[0] == len([f for f in tmp_path.iterdir() if f.suffix in (".json", ".txt", ".xml", ".csv", ".tsv")])


@pytest.mark.parametrize("max_files, max_bytes", [(100, 10**6), (7, 10**6), (100, 300), (9, 40), (0, 50), (5, 0)])
def test_budget_of_a_listing(spark, max_files, max_bytes):
    rng = random.Random(max_bytes + max_files)
    listed = [(f"d{rng.randrange(9)}/f{i}", rng.choice([0, 3, 20, 90])) for i in range(60)]
    left, want = max_bytes, []
    for path, size in sorted(listed):
        if len(want) < max_files and size <= left:
            want.append(path)
            left -= size
    got = readers.within_budget(spark.createDataFrame(listed, "path string, size long"), max_files, max_bytes, range_rows=8)
    assert sorted(r.path for r in got.collect()) == want


def test_exports(spark):
    docs = spark.createDataFrame([(1, "Zoë met Anna, <b>.")], "doc_id int, text string")
    sp = spark.createDataFrame([(1, 8, 12, "PER", 0.9, "Anna", 7)], "doc_id int, start int, end int, label string, confidence double, text string, id int")
    assert [r.line for r in exports.brat(docs, sp.drop("text", "id")).collect()] == ["T1\tPER 9 13\tAnna", "A1\tConfidence T1 0.90"]
    assert [r.line for r in exports.conll(docs, sp).orderBy("position").collect()] == ["Zoë O", "met O", "Anna B-PER", ", O", "<b> O", ". O"]
    assert exports.html(docs, sp).first().line == 'Zoë met <mark class="PER">Anna</mark>, &lt;b&gt;.'
    assert exports.n_triples(sp).count() == 3 and '"@graph"' in exports.json_ld(sp).first().line and exports.jsonl(sp).count() == 1
    import hashlib

    ev = spark.createDataFrame([(1, 10), (2, 20)], "event_id int, t int").withColumn("ts", F.timestamp_seconds("t"))
    a, b = exports.audit_chain(ev).orderBy("event_id").collect()
    assert a.prev_hash == "0" * 64 and b.prev_hash == a.this_hash == hashlib.sha256(("0" * 64 + a.json).encode()).hexdigest()


def test_buffers(spark, tmp_path):
    assert buffers.fold(["Hello", " wor", "ld. See PERS", "ON_", "12 now."]) == (["Hello world. See PERSON_12 now."], "")
    assert buffers.fold(["abc. "]) == (["abc. "], "") and buffers.fold(["x" * 9], most=5) == (["x" * 9], "")
    df = spark.createDataFrame([("a", 2, "two."), ("a", 1, "One "), ("b", 1, "open")], "stream_id string, seq int, fragment string")
    assert rows(buffers.buffered_batch(df), "stream_id", "text") == [("a", "One two."), ("b", "open")]
    sse = spark.createDataFrame([("event: delta\ndata: {\"x\": 1}",), ("data: [DONE]",)], "frame string")
    got = buffers.parse_sse(sse, "x int").collect()
    assert got[0].event == "delta" and got[0].data.x == 1 and got[1].data is None


def test_stream(spark, tmp_path):
    src, schema = tmp_path / "src", "stream_id string, seq int, fragment string, last boolean"
    spark.createDataFrame([("a", 1, "One ", False), ("a", 2, "two.", False), ("b", 1, "tail", True)], schema).coalesce(1).write.json(str(src))
    q = buffers.buffered(spark.readStream.schema(schema).json(str(src))).writeStream.format("memory").queryName("buffered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("buffered"), "stream_id", "text") == [("a", "One two."), ("b", "tail")]
