"""Steps that must grow no faster than their input or their result, and rows that differed from SQL on larger tables."""

import io
import json
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import language
from textloom.operators import coref, extract, index, islands, matching, memory, messages, metrics, pairing, retrieval, spans
from textloom.plans import tables
from textloom.plans.retrieval import line_spans, lines
from textloom.streaming import entities


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_conflicts_meet_only_with_like_embeddings(spark):
    """Of 3,000 memories of one word each meets those of like embeddings, of which there are 300 kinds: all pairs would be 4.5 million."""
    m = spark.range(3_000).select("id", F.lit("preference").alias("kind"), F.col("id").alias("created_at"), F.when(F.col("id") == 0, 1).cast("long").alias("valid_to"), F.array(F.lit("the"), F.lit("a"), F.lit("the")).alias("entity_refs"), F.array(F.cos(F.col("id") % 300), F.sin(F.col("id") % 300)).cast("array<float>").alias("embedding"))
    got = memory.conflicts(m, 0.999999)
    want = {(a, b) for r in range(300) for a in range(r, 3_000, 300) for b in range(r, a, 300) if b}
    pairs = [(x.id, x.prior) for x in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    keys = [line[line.index("Join [") :].split("]")[0] for line in plan(got).splitlines() if "Join [" in line]
    assert any("__v" in k for k in keys)


def test_conflicts_of_missing_and_uneven_embeddings(spark):
    rows = [(1, "preference", 1, None, ["x", None], [1.0, 0.0]), (2, "preference", 2, None, ["x"], [2.0, 0.0]), (3, "preference", 3, None, ["x"], None), (4, "preference", 4, None, ["x"], [1.0, 0.0, 0.0]), (5, "reference", 5, None, ["x"], [1.0, 0.0]), (6, "preference", 6, 9, ["x"], [1.0, 0.0]), (7, "preference", 7, None, None, [1.0, 0.0]), (8, "fact", 8, None, ["x"], [1.0, 0.0])]
    m = spark.createDataFrame(rows, "id long, kind string, created_at long, valid_to long, entity_refs array<string>, embedding array<float>")
    assert sorted((x.id, x.prior) for x in memory.conflicts(m).collect()) == [(2, 1), (6, 1), (6, 2)]


def greedy(rows):
    """Pairs (key, left, right, score), best first within a key, each of whose sides is free."""
    taken, used, out = set(), set(), []
    for k, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (k, a) not in taken and (k, b) not in used:
            taken.add((k, a))
            used.add((k, b))
            out.append((k, a, b))
    return sorted(out, key=str)


def test_one_to_one_over_batches(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(9), r.randrange(9), r.randrange(4)) for k in (*range(40), None) for _ in range(30)]
    df = spark.createDataFrame(rows, "k int, a int, b int, s int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pairing.one_to_one(df, "k", [F.desc("s"), F.col("a"), F.col("b")], ["a"], ["b"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((x.k, x.a, x.b) for x in got), key=str) == greedy(rows)


def test_ceaf_starts_nothing_for_each_document(spark):
    rows = [(side, d, (m * (3 if side == "gold" else 2) + d) % 4, m, m + 1) for side in ("gold", "pred") for d in range(200) for m in range(6)]
    got = coref.ceaf(spark.createDataFrame(rows, "side string, doc_id int, chain_id int, start int, end int"))
    assert "FlatMapGroupsInPandas" not in plan(got)
    total = 0.0
    for d in range(200):
        chains = {s: {} for s in ("gold", "pred")}
        for side, own, c, m, _ in rows:
            if own == d:
                chains[side].setdefault(c, set()).add(m)
        score = {(g, p): 2 * len(x & y) / (len(x) + len(y)) for g, x in chains["gold"].items() for p, y in chains["pred"].items() if x & y}
        total += sum(score[g, p] for _, g, p in greedy([(0, g, p, s) for (g, p), s in score.items()]))
    assert got.first().precision == pytest.approx(total / len({(d, c) for s, d, c, *_ in rows if s == "pred"}))


def test_conll_is_the_mean_of_its_three(spark):
    rows = [(side, d, (m + d * (side == "gold")) % 3, m, m + 1) for side in ("gold", "pred") for d in range(30) for m in range(5)]
    df = spark.createDataFrame(rows, "side string, doc_id int, chain_id int, start int, end int")
    got = coref.conll(df)
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert got.first().f1 == pytest.approx(sum(f(df).first().f1 for f in (coref.muc, coref.b_cubed, coref.ceaf)) / 3)


def test_error_analysis_as_a_loop_would(spark):
    r = random.Random(9)
    rows = [(side, k, s := r.randrange(30), s + r.randrange(1, 9), r.choice("ab")) for side in "gp" for k in range(25) for _ in range(12)]
    df = spark.createDataFrame(rows, "side string, k int, start int, end int, label string")
    got = spans.error_analysis(df.filter("side = 'g'").drop("side"), df.filter("side = 'p'").drop("side"), "k", 0.3)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = []
    for k in range(25):
        gold, left = (sorted({x[2:] for x in rows if x[:2] == (side, k)}) for side in "gp")
        for g in gold:
            iou = lambda p: (min(g[1], p[1]) - max(g[0], p[0])) / (max(g[1], p[1]) - min(g[0], p[0]))  # noqa: B023, E731
            met = sorted((p for p in left if iou(p) > 0.3), key=lambda p: (p[:2] != g[:2], p[2] != g[2], -iou(p), p))
            if met:
                left.remove(met[0])
                want.append((k, {(True, True): "correct", (True, False): "type", (False, True): "boundary"}.get((met[0][:2] == g[:2], met[0][2] == g[2]), "partial"), g[2], met[0][2]))
            else:
                want.append((k, "false_negative", g[2], None))
        want += [(k, "false_positive", None, p[2]) for p in left]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def script_of(text):
    """The script by counting characters one by one."""
    bare = re.sub(language.IGNORED, "", text)
    counts = [len(re.findall(f"[{p}]", bare)) for _, p in language.SCRIPTS]
    every = [*counts, len(bare) - sum(counts)]
    if not bare or sum(c >= max(len(bare) * 2 // 10, 1) for c in every) >= 2:
        return "mixed"
    return [*(n for n, _ in language.SCRIPTS), "mixed"][max(i for i, c in enumerate(every) if c == max(every))]


def test_scripts_are_counted_once(spark):
    r = random.Random(3)
    signs = "abé ßΩЖж漢かカ한عאไन𝔸😀\u0085 　!-~\t" + "ɏɐἀ"
    texts = ["".join(r.choice(r.sample(signs, 3)) for _ in range(r.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", language.detect_script(F.col("text")).alias("script"))
    assert {x.i: x.script for x in df.collect()} == dict(enumerate(map(script_of, texts)))
    assert spark.createDataFrame([(None,)], "text string").select(language.detect_script(F.col("text")).alias("s")).first().s == "mixed"
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_count") <= len(language.SCRIPTS)


@pytest.mark.parametrize("between, want", [(" in ", "LOCATED_IN"), (" inä", "LOCATED_IN"), ("éin ", "LOCATED_IN"), (" ind", "UNKNOWN"), ("_in_", "UNKNOWN"), ("9in ", "UNKNOWN"), ("IN", "LOCATED_IN"), ("x in", "LOCATED_IN")])
def test_relations_take_ascii_borders_of_words_as_sql_does(spark, between, want):
    docs = spark.createDataFrame([(1, f"Aaaaa{between}Bbbbb")], "doc_id long, text string")
    entities = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5 + len(between), 10 + len(between))], "doc_id long, idx int, start int, end int")
    assert [x.relation for x in extract.relation_pairs(docs, entities).collect()] == [want]


def test_fused_arms_meet_whatever_way_each_was_dealt(spark):
    """Arms ranked by windows of their own, one of many rows, whose partitions adaptive plans cut differently."""
    arm = lambda n, wide: spark.range(n).select((F.col("id") % 5).cast("string").alias("query"), F.floor(F.col("id") / 5).alias("doc"), F.repeat(F.lit("x"), wide).alias("pad")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc", "pad"))).filter("rank <= 50")
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for c, v in zip(old, ("24", "20000", "false")):
        spark.conf.set(c, v)
    try:
        fused = retrieval.fuse([arm(60_000, 60), arm(500, 1)], "doc", 10)
        first = plan(fused)
        got = [(x.query, x.doc, x.rank) for x in fused.collect()]
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted(got) == sorted((str(q), d, d + 1) for q in range(5) for d in range(10))
    assert "Exchange" in first[: first.index("Union")].split("HashAggregate")[-1]


def slow_take(memory, text):
    """Memory.take by asking every entity in turn."""
    key = entities.form(text)
    best, score = None, 0.0
    for i in sorted(memory.entities):
        s = entities.fit(key, memory.entities[i])
        if s >= entities.LEAST and s > score:
            best, score = i, s
    return (memory.number, 0.0) if best is None else (best, score)


@pytest.mark.parametrize("policy", [entities.Policy(), entities.Policy("lru", 5), entities.Policy("lfu", 4), entities.Policy("dual", 3, 2)])
@pytest.mark.parametrize("seed", range(4))
def test_memory_finds_what_asking_every_entity_finds(policy, seed):
    r = random.Random(seed)
    words = ["a", "ab", "abc", "bcab", "Ünïa", "he", "it", "aaa", "aaaa", "aaaaa", "xyz", "zyx yx", "‎", "Corp.", "of"]
    memory = entities.Memory(policy)
    for _ in range(600):
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 6))) if r.random() < 0.3 else r.choice((" ", "")).join(r.choices(words, k=r.randrange(1, 4)))
        assert slow_take(memory, text) == memory.take(text)


def test_memory_asks_few_entities_of_many(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(entities, "fit", lambda *a: asked.append(a) or 0.0)
    memory = entities.Memory()
    for i in range(2_000):
        memory.take(f"x{i:05d}y first{i} last{i}")
    assert len(memory.entities) == 2_000 and not asked
    got = entities.replayed(spark.createDataFrame([(s, i, f"n{i}") for s in ("p", None, "q") for i in range(3)], "stream_id string, seq long, text string"))
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert sorted(((x.stream_id or "", x.seq, x.entity) for x in got.collect())) == sorted((s, i, i) for s in ("", "p", "q") for i in range(3))


@pytest.mark.parametrize("odd", [[], [("gold", 0, 9, 0, 1), ("pred", 1, None, 1, 2), ("gold", None, 1, 0, 1), ("pred", None, 1, 0, 1), ("gold", 3, None, 2, 3), ("gold", 2, 1, None, 4), ("pred", 2, 1, None, 4), ("pred", 77, 1, 0, 1)]])
def test_conll_reads_its_mentions_once(spark, odd):
    r = random.Random(6)
    rows = [(side, d, r.randrange(3), m, m + 1) for side in ("gold", "pred") for d in range(40) for m in r.sample(range(1, 9), 5)]
    df = spark.createDataFrame(rows + [x for x in odd if x[3] is None or x[0] == "gold" or x[1] in (None, 77)], "side string, doc_id int, chain_id int, start int, end int")
    got = coref.conll(df)
    assert plan(got).count("Scan") == 1 and "Join" not in plan(got)
    assert got.first().f1 == pytest.approx(sum(f(df).first().f1 for f in (coref.muc, coref.b_cubed, coref.ceaf)) / 3)
    assert coref.conll(df.limit(0)).first().f1 == 0


def test_parts_of_a_deal_grow_with_the_table(spark, monkeypatch):
    assert tables.dealt(spark.range(100), "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "ROWS", 10)
    assert tables.dealt(spark.range(105), "id").rdd.getNumPartitions() == 11
    for found in (lines, line_spans):
        shuffles = [x for x in plan(found(spark, "/root/testdata/sf0.001")).splitlines() if "Exchange" in x]
        assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]
    spans_ = line_spans(spark, "/root/testdata/sf0.001").withColumn("layer", F.col("id") % 3)
    for name in ("priority", "longest", "confidence"):
        assert plan(islands.stack(spans_, ["k"], name)).count("Exchange") == 1


def test_window_fragmentation_repeats_no_rows(spark):
    rows = [(d, s, g, p) for d in range(20) for s, g, p in [(0, 1, 1), (1, 1, None), (9, 1, 2 if d % 2 else 1), (None, 2, 1), (3, 2, 2), (8, None, 1), (2, None, 3), (4, 4, None), (40, 4, None)]]
    df = spark.createDataFrame(rows, "doc_id int, start int, gold int, pred int")
    got = metrics.window_fragmentation(df, 4, 1)
    assert "Expand" not in plan(got)
    assert tuple(got.first()) == (80, 60, 30, 60)


def test_boxes_meet_once_for_all_counts(spark):
    r = random.Random(8)
    boxes = [(r.randrange(3), i, float(x := r.randrange(300)), float(y := r.randrange(300)), x + r.uniform(5, 90), y + r.uniform(5, 90), r.choice("ab"), r.choice(("u", "U", "v"))) for i in range(150)]
    moved = [(p, i + 1000, x + r.choice((0, 1, 9)), y, u, v, k, t) for p, i, x, y, u, v, k, t in boxes]
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double, label string, text string"
    g, p = spark.createDataFrame(boxes, schema), spark.createDataFrame(moved, schema)
    got = matching.box_scores(g, p, "page")
    first = plan(got)
    assert first.count("__x") and sum("SortMergeJoin" in x and "__x" in x or "HashJoin" in x and "__x" in x for x in first.splitlines()) == 1
    pairs = []
    for a in boxes:
        for b in moved:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and a[6] == b[6] and w > 0 and h > 0 and b[2] < b[4]:
                both = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h
                pairs.append((a[1], b[1], w * h / both, a[7].lower() == b[7].lower()))
    first_of = {}
    for i, j, s, said in sorted(pairs, key=lambda x: (-x[2], x[0])):
        if s >= 0.5 and said:
            first_of.setdefault(j, i)
    x = got.first()
    assert x.mean_iou == pytest.approx(sum(s for *_, s, _ in pairs) / len(pairs))
    assert x.box_recall == pytest.approx(len({i for i, _, s, _ in pairs if s >= 0.5}) / 150) and x.both_recall == pytest.approx(len(set(first_of.values())) / 150)
    assert matching.box_scores(g.limit(0), p, "page").first().mean_iou == 0


def test_index_partitions_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """A term that all documents have is joined where its rows lie, and documents are dealt into more partitions as their texts grow."""
    monkeypatch.setattr(index, "SHARE", 2_000)
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word"), F.col("id")).alias("text"), F.col("id").alias("added"))
    path, asked = str(tmp_path / "i"), spark.createDataFrame([("q", ["the", "word7"])], "query string, terms array<string>")
    index.refresh(path, docs.filter("added < 600"))
    found = index.search(path, docs, asked)
    assert "SortMergeJoin" not in plan(found)
    plain = retrieval.bm25(docs.select("doc_id", "text"), asked)
    assert {r.doc_id: round(r.score, 9) for r in found.collect()} == {r.doc_id: round(r.score, 9) for r in plain.collect()}
    rows = index._rows(docs, "doc_id", "text", "added", None)
    assert index._newest(rows, 11_000).rdd.getNumPartitions() == 6


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path):
    """Ten texts of 1 MB come to a worker in batches of about BATCH bytes, whatever the rows of a batch may be."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(10).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = tables.table(spark, str(tmp_path), "documents").mapInPandas(lambda batches: (b[["doc_id"]].agg(["size"]) for b in batches), "doc_id long")
    assert max(r[0] for r in sizes.collect()) <= 5


def test_fragments_are_dealt_once(spark):
    """Two counts, one for fragments and one for pairs, share the exchange by key; the rest are sums of one row each."""
    r = random.Random(4)
    rows = [(r.randrange(6), r.randrange(4), r.choice("ab"), s := r.randrange(300), s + r.randrange(0, 150)) for _ in range(300)]
    schema = "d int, entity int, label string, start int, end int"
    gold, predicted = rows[:160], rows[140:]
    own = {}
    for g, side in ((True, gold), (False, predicted)):
        for d, e, label, a, b in side:
            if a < b:
                own.setdefault((g, d, e), []).append((a, b, label))
    label, size = {k: min(x[2] for x in v) for k, v in own.items()}, {k: sum(x[1] - x[0] for x in v) for k, v in own.items()}
    best = dict.fromkeys(own, 0.0)
    for a in own:
        for b in own:
            if a[0] and not b[0] and a[1] == b[1] and label[a] == label[b]:
                score = 2 * sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x in own[a] for y in own[b]) / (size[a] + size[b])
                best[a], best[b] = max(best[a], score), max(best[b], score)
    mean = lambda side: sum(v for k, v in best.items() if k[0] == side) / sum(k[0] == side for k in own)
    scores = matching.fragment_scores(spark.createDataFrame(gold, schema), spark.createDataFrame(predicted, schema), "d", parts=3)
    row = scores.first()
    assert (row.partial_recall, row.partial_precision) == (pytest.approx(mean(True)), pytest.approx(mean(False)))
    assert (row.gold, row.predicted) == (sum(k[0] for k in own), sum(not k[0] for k in own))
    assert set(re.findall(r"Exchange hashpartitioning\(d#", plan(scores))) and not re.search(r"Exchange hashpartitioning\([^)]*,[^)]*ENSURE_REQUIREMENTS", plan(scores))


def test_batches_of_the_operators_are_bounded_by_bytes(spark, tmp_path):
    """500 rows may be 500 long texts: JVM and worker hold a batch each, so it is cut by bytes too."""
    from textloom.llm import common

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(10).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    try:
        sizes = common.table(spark, str(tmp_path), "documents").mapInPandas(lambda batches: (b[["doc_id"]].agg(["size"]) for b in batches), "doc_id long")
        assert max(r[0] for r in sizes.collect()) <= 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trees_are_opened_in_one_pass_and_written_in_one_shuffle(spark, monkeypatch):
    """Levels were written one by one, and each level of a rebuilt tree read the leaves twice."""
    made = []
    stash = messages.stash
    monkeypatch.setattr(messages, "stash", lambda df, name: made.append(name) or stash(df, name))
    deep = {"a": [{"b": [[], {"c": [1, "x", {"\"d": None}]}, {}]}, "e"]}
    for _ in range(9):
        deep = {"in": [deep, "y"], "z": {}}
    trees = {1: {"messages": [{"content": [{"text": "a@b.io", "type": "text"}], "role": "user"}], "system": "s"}, 2: [], 3: "t", 4: None, 5: deep}
    df = spark.createDataFrame([(i, None if t is None else json.dumps(t)) for i, t in trees.items()], "id long, t string").select("id", F.parse_json("t").alias("tree"))
    messages.flatten(df.filter("id < 5"))
    assert made == ["trees"]
    again = messages.rebuild(messages.flatten(df))
    assert made == ["trees"] * 5  # 25 levels in four passes of 8
    assert plan(again).count("Exchange") == 1
    got = again.select("id", F.to_json("tree").alias("t")).collect()
    assert {r.id: None if r.t is None else json.loads(r.t) for r in got} == trees


def test_risks_meet_where_their_lines_are_dealt(spark, tmp_path):
    """Rules and models met in a join by document and category, in partitions whose number did not grow with the table."""
    from textloom.operators import subjects
    from textloom.plans import records

    lines = spark.range(60).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("1995-01-01").cast("date").alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = records.risks_merged(spark, str(tmp_path))
    written = plan(got)
    assert "Join" not in written and not re.search(r"hashpartitioning\(doc_id", written)
    assert sorted(map(tuple, got.collect())) == [("model", "R", 21), ("rule", "R", 19)]
    rule = spark.createDataFrame([(1, None, "low"), (None, "a", "low"), (2, "a", "low"), (2, "a", "high")], "doc_id int, category string, severity string")
    model = spark.createDataFrame([(1, None, "low"), (1, None, "high"), (None, "a", "low"), (2, "a", "critical"), (2, "b", None)], "doc_id long, category string, severity string")
    found = subjects.merge_risks(rule, model).filter("source = 'model'").collect()
    assert {tuple(r)[:3] for r in found} == {(1, None, "high"), (None, "a", "low"), (2, "b", None)} and len(found) == 3


def test_a_walk_over_chunks_reads_the_lines_once(spark, tmp_path):
    """Each kind of node and edge dealt and grouped the lines anew, and events met documents twice, so that those of a document named k times came k * k times."""
    from textloom.operators import dossier
    from textloom.plans import dossier as plans

    d = str(tmp_path)
    day = F.lit("1995-01-01").cast("date")
    spark.range(20).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(5.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), day.alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(20).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range(20).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name")).write.parquet(f"{d}/customer.parquet")
    for query in (plans.case_file_review, plans.contract_review):
        assert "REPARTITION_BY_NUM" not in plan(query(spark, d))
    assert plans.case_file_review(spark, d).count() == 39
    nodes, edges = plans.case_graph(spark, d)
    twice = nodes.unionByName(nodes.filter("label = 'Document'"))
    assert dossier.timeline(twice, edges).count() == 2 * dossier.timeline(nodes, edges).count() == 26
