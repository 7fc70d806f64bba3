"""Islands, entities across documents, rewriting, entity memories, pieces and boxes, the stored index, message trees, diversity and fan-out against plain versions."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import diversity, fanout, index, islands, matching, messages, resolve, retrieval, rewriting
from textloom.streaming import entities


def test_islands_touching_nested_and_null_keys(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 6, 7), (1, 8, 12), (None, 0, 3), (None, 2, 4), (2, 4, 4)], "k int, start int, end int")
    got = {(r.k, r.start, r.end): r.island for r in islands.number_islands(df, ["k"]).collect()}
    assert got == {(1, 0, 5): 1, (1, 5, 9): 2, (1, 6, 7): 2, (1, 8, 12): 2, (None, 0, 3): 1, (None, 2, 4): 1, (2, 4, 4): 1}


def stacked(rows, strategy):
    """The layered rule over one document's spans (start, end, label, confidence, layer), span by span."""
    kept = []
    for s in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[0] < r[1]), key=lambda r: (r[4], r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0)):
        hits = [k for k in kept if k[0] < s[1] and k[1] > s[0]]
        if not hits:
            kept.append(s)
            continue
        value = {"priority": lambda k: 0, "longest": lambda k: k[1] - k[0], "confidence": lambda k: k[3] or 0}[strategy]
        best = max(hits, key=value)  # the first of the greatest
        covers = s[0] <= best[0] and s[1] >= best[1] and s[2] in islands.STRUCTURED and best[2] not in islands.NAMED
        wins = covers or value(s) > value(best)
        kept = [s if wins and k is best else k for k in kept if k is best or k not in hits]
    return sorted({(k[0], k[1], k[2]) for k in kept}, key=str)


@pytest.mark.parametrize("strategy", ["priority", "longest", "confidence"])
def test_stacks(spark, strategy):
    r = random.Random(4)
    rows = [(d, s := r.randrange(60), s + r.randrange(0, 12), r.choice(["MONEY", "PER", "MISC", None]), r.choice([None, 0.2, 0.5, 0.9]), r.randrange(3)) for d in range(12) for _ in range(25)] + [(1, None, 4, "PER", 0.1, 0), (1, 3, None, "PER", 0.1, 0)]
    got = islands.stack(spark.createDataFrame(rows, "d int, start int, end int, label string, confidence double, layer int"), ["d"], strategy).collect()
    for d in range(12):
        assert sorted(((x.start, x.end, x.label) for x in got if x.d == d), key=str) == stacked([x[1:] for x in rows if x[0] == d], strategy)


def test_stack_refuses_unknown_strategies_and_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "d int, start int, end int, label string, confidence double, layer int")
    assert islands.stack(empty, ["d"], "longest").collect() == [] and islands.choose(empty, ["d"], [F.col("start")]).collect() == []
    with pytest.raises(ValueError):
        islands.stack(empty, ["d"], "best")


def clusters(sets, least):
    """Least ids of the components of all alike pairs of (id, kind, words)."""
    root = {i: i for i, *_ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, k, x), (b, m, y) in itertools.combinations(sets, 2):
        if k == m and x and y and len(x & y) / len(x | y) >= least - 1e-9:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed, least, block", [(0, 0.7, 64), (1, 0.5, 3), (2, 0.6, 2), (3, 0.8, 1), (4, 0.34, 4)])
def test_links_reach_what_all_pairs_reach(spark, seed, least, block):
    r = random.Random(seed)
    sets = [(i, r.choice("ab"), {r.choice("abcdefghijkl"[: r.choice([5, 12])]) for _ in range(r.randrange(0, 9))}) for i in range(150)]
    df = spark.createDataFrame([(i, k, sorted(w)) for i, k, w in sets], "id long, kind string, words array<string>")
    got = {x.node: x.cluster for x in resolve.components(resolve.set_links(df, least, block)).collect()}
    want = clusters(sets, least)
    assert {i: got.get(i, i) for i in want} == want


def test_ten_thousand_equal_and_one_hot_word(spark):
    """Equal mentions are one set; a word of all mentions is lengthened, and what it does not part is tied to the least."""
    rows = [(i, i % 7, "Acme Holding Group", "ORG") for i in range(10_000)] + [(10_000 + i, 1, f"acme holding group of x{i}", "ORG") for i in range(2_000)] + [(20_000, 2, "ACME's Holding group", None), (None, 3, "Acme", "ORG"), (20_001, 4, None, "ORG"), (20_002, 5, "  ", "ORG")]
    got = {x.id: x for x in resolve.entities(spark.createDataFrame(rows, "id long, doc_id int, text string, type string")).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert got[9_999].cluster == 0 and got[9_999].documents == 7 and got[5].name == "Acme Holding Group"
    assert got[10_005].cluster == 10_005 and got[20_000].cluster == 20_000 and got[None].cluster is None and got[20_002].cluster == got[20_001].cluster == 20_001
    near = spark.createDataFrame([(i, 0, f"one two three four five six seven {i}", "T") for i in range(400)], "id long, doc_id int, text string, type string")
    assert {x.cluster for x in resolve.entities(near, 0.7).collect()} == {0}


def test_components_of_a_chain_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (3, 2), (3, 2)]
    got = {x.node: x.cluster for x in resolve.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert resolve.components(spark.createDataFrame([], "a long, b long")).collect() == []


TEXT = "Alice went home. She slept. It is clear that it rains. It was late, said Bob; he saw herself and it."


def said(words, text=TEXT):
    out = []
    at = 0
    for w, kind, chain in words:
        at = text.index(w, at)
        out.append((1, at, at + len(w), w, kind, chain))
        at += len(w)
    return out


def test_rewriting(spark):
    schema = "doc_id long, start int, end int, text string, type string, chain long"
    mentions = said([("Alice", "P", None), ("She", "P", None), ("It", "T", None), ("it", "T", None), ("It", "T", None), ("Bob", "P", 4), ("he", "P", 4), ("herself", "P", None), ("it", "T", None)])
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "no mention")], "doc_id long, text string")
    out = {x.doc_id: x for x in rewriting.self_contained(docs, spark.createDataFrame(mentions, schema)).collect()}
    assert out[1].text == TEXT.replace("She slept", "Alice slept").replace("; he", "; Bob") and out[1].rewrites == 2
    assert (out[2].text, out[2].rewrites, out[3].text, out[3].rewrites) == (None, 0, "no mention", 0)
    more = rewriting.self_contained(docs, spark.createDataFrame(mentions, schema), reflexives=True).filter("doc_id = 1").first()
    assert "saw Bob and" in more.text and more.rewrites == 3
    # forward, and only within reach
    ahead = spark.createDataFrame([(5, "When she came, " + "x" * n + " Ann sat.") for n in (3,)] + [(6, "When she came, " + "x" * 600 + " Ann sat.")], "doc_id long, text string")
    found = spark.createDataFrame([(5, 5, 8, "she", "P", None), (5, 19, 22, "Ann", "P", None), (6, 5, 8, "she", "P", None), (6, 616, 619, "Ann", "P", None)], schema)
    assert {x.doc_id: (x.replacement, x.source) for x in rewriting.antecedents(ahead, found).collect()} == {5: ("Ann", "after")}
    assert rewriting.antecedents(ahead, found, cataphora=False).collect() == []
    # of overlapping replacements the longest; a capital stays one
    both = spark.createDataFrame([(3, 0, 2, "no", "yes", "x"), (3, 0, 10, "No mention", "some mention", "x")], "doc_id long, start int, end int, original string, replacement string, source string")
    assert {x.text for x in rewriting.splice(docs, both).filter("doc_id = 3").collect()} == {"Some mention"}


def test_what_an_it_stands_for(spark):
    cases = {"It is clear that so": True, "it was to be": True, "It seems that x": True, "it rains": True, "it turned out": True, "it is late": False, "it has that to": False, "It follows that x": True}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rewriting.refers_to_nothing(F.col("t"), F.lit(2)).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == cases


MENTIONS = [("s", i, t) for i, t in enumerate("John Smith|Mary Jones|Smith|he|John|he|Mary|Jones & Co|mary jones|Smith|Anna|Anna Jones|Bob|John Smithers|she|she".split("|"))]


def test_memory_joins_and_begins():
    memory = entities.Memory()
    got = [memory.take(t) for _, _, t in MENTIONS]
    assert [i for i, _ in got[:6]] == [0, 1, 0, 2, 0, 2] and got[2][1] == entities.WITHIN and got[5][1] == entities.NAME
    assert entities.fit("mary x", entities.Entity("Mary Jones", ["mary jones"], 0, 1)) == entities.FIRST and entities.fit("he", entities.Entity("Bob", ["bob"], 0, 1)) == entities.PRONOUN


@pytest.mark.parametrize("policy, most", [(entities.Policy("lru", 3), 3), (entities.Policy("lfu", 2), 2), (entities.Policy("dual", 2, 2), 4)])
def test_policies_bound_the_memory(policy, most):
    memory = entities.Memory(policy)
    for k, (_, _, t) in enumerate(MENTIONS):
        last, _ = memory.take(t)
        assert len(memory.entities) <= most and last in memory.entities
    with pytest.raises(ValueError):
        entities.Policy("lru")


def test_frequent_entities_outlive_rare_ones():
    memory = entities.Memory(entities.Policy("lfu", 2))
    for t in ("Ann", "Ann", "Bea", "Cid", "Ann"):
        at = memory.take(t)
    assert at == (0, entities.NAME)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_batches_of_any_size_give_the_same_entities_and_state_survives_a_restart(spark, tmp_path, size):
    rows = MENTIONS + [("t", k, t) for k, (_, _, t) in enumerate(reversed(MENTIONS))]
    want = sorted((r.stream_id, r.seq, r.entity) for r in entities.replayed(spark.createDataFrame(rows, "stream_id string, seq long, text string")).collect())
    if size == 1:
        rows = rows[:16:2] + rows[16:]  # fewer batches of one
        want = sorted((r.stream_id, r.seq, r.entity) for r in entities.replayed(spark.createDataFrame(rows, "stream_id string, seq long, text string")).collect())
        size = 5
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = tmp_path / "in"
    source.mkdir()
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    try:
        for run in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):  # the second query starts from the first's checkpoint
            for part in run:
                (source / f"{len(list(source.iterdir())):04}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "text"), r, strict=True))) for r in part))
                stream = spark.readStream.schema("stream_id string, seq long, text string").json(str(source))
                query = entities.remembered(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
                query.awaitTermination()
        got = sorted((r.stream_id, r.seq, r.entity) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_an_idle_stream_is_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source = tmp_path / "in"
    source.mkdir()
    write = lambda k: (source / f"{k}.json").write_text(json.dumps({"stream_id": "s", "seq": k, "text": f"Name{k} Smith{k}"}))
    write(0)
    query = entities.remembered(spark.readStream.schema("stream_id string, seq long, text string").json(str(source)), idle_ms=1500).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).start()

    def wait(n):
        end = time.time() + 40
        while spark.table("idle").count() < n and time.time() < end:
            time.sleep(0.5)

    try:
        wait(1)
        time.sleep(6)
        write(1)
        wait(2)
        assert [r.entity for r in spark.table("idle").orderBy("seq").collect()] == [0, 0]
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fragments(spark):
    schema = "d int, entity int, label string, start int, end int"
    gold = spark.createDataFrame([(1, 1, "A", 0, 4), (1, 1, "A", 10, 14), (1, 2, "B", 20, 30), (2, 1, "A", 0, 5), (2, 9, "A", 3, 3)], schema)
    predicted = spark.createDataFrame([(1, 7, "A", 0, 4), (1, 7, "A", 12, 14), (1, 8, "A", 20, 30), (2, 1, "A", 0, 5)], schema)
    s = matching.fragment_scores(gold, predicted, "d").first()
    assert (s.gold, s.predicted, s.exact_precision, s.boundary_recall) == (3, 3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert s.partial_recall == pytest.approx((12 / 14 + 0 + 1) / 3)
    assert matching.fragment_scores(gold, predicted, "d", match_type=False).first().exact_recall == pytest.approx(2 / 3)
    none = spark.createDataFrame([], schema)
    assert matching.fragment_scores(none, none, "d").first().exact_f1 == 1 and matching.fragment_scores(gold, none, "d").first().partial_f1 == 0


def test_boxes_meet_once_and_no_other(spark):
    r = random.Random(6)
    boxes = [(r.choice([1, 2, None]), i, x := r.uniform(-99, 300), y := r.uniform(-99, 300), x + r.choice([0, 5, 90, 400]), y + r.choice([-1, 5, 90, 400])) for i in range(80)]
    df = spark.createDataFrame(boxes, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    got = {(x.page, x.id, x.id_r): x.iou for x in matching.box_pairs(df, df, "page").collect()}
    want = {}
    for a, b in itertools.product(boxes, boxes):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if a[0] is not None and a[0] == b[0] and w > 0 and h > 0:
            area = lambda x: (x[4] - x[2]) * (x[5] - x[3])
            want[a[0], a[1], b[1]] = w * h / (area(a) + area(b) - w * h)
    assert got == pytest.approx(want) and matching.box_pairs(df, df, "page").count() == len(want)


def test_index_equals_a_search_of_all_texts(spark, tmp_path):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(0, 9))), i) for i in range(60)] + [(60, None, 60)]
    schema = "doc_id long, text string, added long"
    asked = spark.createDataFrame([("q", ["alpha", "delta"]), ("r", ["omega"])], "query string, terms array<string>")
    path = str(tmp_path / "index")

    def same(rows):
        docs = spark.createDataFrame(rows, schema)
        newest = {}
        for i, t, a in rows:
            newest[i] = max(newest.get(i, (-1, "")), (a, t or ""))
        plain = spark.createDataFrame([(i, t) for i, (_, t) in newest.items()], "doc_id long, text string")
        plain_rows = {(x.query, x.doc_id): x.score for x in retrieval.bm25(plain, asked).collect()}
        return {(x.query, x.doc_id): x.score for x in index.search(path, docs, asked).collect()} == pytest.approx(plain_rows)

    assert same(texts)  # no index
    assert index.refresh(path, spark.createDataFrame(texts[:30], schema)) == 0 and same(texts)
    assert index.refresh(path, spark.createDataFrame(texts[:30], schema)) == -1
    again = [*texts, (3, "alpha alpha omega", 70), (60, "delta", 71)]
    assert index.refresh(path, spark.createDataFrame(texts, schema)) == 1 and same(again)  # replaced, not yet indexed
    assert index.refresh(path, spark.createDataFrame(again, schema)) == 2 and same(again) and same([*again, (3, "beta", 80)])
    broken = tmp_path / "index" / "postings" / "batch=3" / "bucket=1"
    broken.mkdir(parents=True)
    (broken / "left.parquet").write_bytes(b"not finished")
    assert same(again)


TREES = [
    (1, {"system": "Call 555-123-4567", "messages": [{"role": "user", "content": "mail a@b.io or a@b.io"}, {"role": "assistant", "content": [{"type": "text", "text": 'x "q" \\ é\n a@b.io'}, {"type": "tool_use", "id": "a@b.io", "input": {"to": ["c@d.org", 5, None, True], "deep": {"k": "c@d.org"}}}, {"type": "tool_result", "content": [{"type": "text", "text": "a@b.io"}, {"type": "image", "text": "a@b.io"}]}]}], "model": "a@b.io", "n": 1.5, "e": {}, "l": []}),
    (2, None),
    (3, {"messages": []}),
    (4, "just text"),
    (5, {"system": [{"type": "thinking", "text": "c@d.org"}], "é\"": {"a": None}}),
]


def test_message_trees_round_trip(spark):
    df = spark.createDataFrame([(i, None if t is None else json.dumps(t)) for i, t in TREES], "id long, t string").select("id", F.parse_json("t").alias("tree"))
    same = lambda rows: {r.id: None if r.t is None else json.loads(r.t) for r in rows.select("id", F.to_json("tree").alias("t")).collect()}
    assert same(messages.rebuild(messages.flatten(df))) == dict(TREES)
    empty = spark.createDataFrame([], "type string, text string, token string")
    hidden, vault = messages.pseudonymise(df, empty)
    out = same(hidden)
    assert {(v.type, v.text) for v in vault.collect()} == {("CONTACT", "555-123-4567"), ("CONTACT", "a@b.io"), ("CONTACT", "c@d.org")}
    token = {v.text: v.token for v in vault.collect()}
    first = out[1]["messages"]
    assert first[0]["content"] == f"mail {token['a@b.io']} or {token['a@b.io']}" and first[1]["content"][1]["input"]["to"] == [token["c@d.org"], 5, None, True]
    assert first[1]["content"][1]["id"] == out[1]["model"] == first[1]["content"][2]["content"][1]["text"] == "a@b.io"
    assert first[1]["content"][2]["content"][0]["text"] == token["a@b.io"] and out[5]["system"][0]["text"] == token["c@d.org"]
    assert same(messages.restore(hidden, vault, messages.request_scope)) == dict(TREES)
    answer = spark.createDataFrame([(1, json.dumps({"content": [{"type": "text", "text": f"to {token['a@b.io']}, PERSON_9"}], "id": token["a@b.io"]}))], "id long, t string").select("id", F.parse_json("t").alias("tree"))
    assert same(messages.restore(answer, vault)) == {1: {"content": [{"type": "text", "text": "to a@b.io, PERSON_9"}], "id": token["a@b.io"]}}


@pytest.mark.parametrize("pool", [2, 9, 256])
def test_farthest_first_is_greedy(spark, pool):
    r = np.random.default_rng(3)
    vectors = {i: r.normal(size=6).round(3) for i in range(90)}
    vectors[91] = vectors[3]
    vectors[92] = np.zeros(6)
    sure = {i: float(r.random()) for i in vectors}
    unit = {i: v / max(np.linalg.norm(v), 1e-300) for i, v in vectors.items()}
    chosen, far = [min(sure, key=lambda i: (sure[i], i))], dict.fromkeys(vectors, np.inf)
    while len(chosen) < 15:
        for i in far:
            far[i] = min(far[i], round(1 - float(unit[i] @ unit[chosen[-1]]), 10))
        chosen.append(min((i for i in far if i not in chosen), key=lambda i: (-far[i], i)))
    rows = [(i, v.tolist(), sure[i]) for i, v in vectors.items()] + [(None, [1.0] * 6, 0.0), (200, None, 0.0), (201, [1.0], 0.0), (5, vectors[5].tolist(), sure[5])]
    got = diversity.farthest_first(spark.createDataFrame(rows, "vec_id long, embedding array<double>, sure double").repartition(5), 15, confidence="sure", pool=pool).orderBy("rank").collect()
    assert [x.id for x in got] == chosen and got[0].distance is None
    few = diversity.farthest_first(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, sure double"), 9).collect()
    assert len(few) == 3 and diversity.farthest_first(spark.createDataFrame([], "vec_id long, embedding array<double>"), 3).collect() == []


def test_a_poisoned_row_costs_itself(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def work(text):
        import uuid

        (seen / f"{text}-{uuid.uuid4().hex}").write_text("")
        if text == "bad":
            raise RuntimeError("poison")
        return text.upper() if text else None

    df = spark.createDataFrame([(1, "a", "x"), (2, "bad", "x"), (3, "a", "x"), (4, None, "x")], "doc_id long, content string, status string")
    path = str(tmp_path / "out")
    states = lambda d: {x.doc_id: (x.status, x.result, x.attempts) for x in d.collect()}
    assert states(fanout.ingest(df, work, path, "1", attempts=2)) == {1: ("done", "A", 1), 2: ("failed", None, 1), 3: ("done", "A", 1), 4: ("done", None, 1)}
    more = df.unionByName(spark.createDataFrame([(5, "new", "x")], df.schema))
    assert states(fanout.ingest(more, work, path, "1", attempts=2))[2] == ("quarantined", None, 2)
    out = fanout.ingest(more, work, path, "1", attempts=2)
    assert out.filter("doc_id = 2").first().error == "RuntimeError: poison" and states(out)[5] == ("done", "NEW", 1)
    runs = [f.name.split("-")[0] for f in seen.iterdir()]
    assert sorted(runs) == ["None", "a", "bad", "bad", "new"]
    assert states(fanout.ingest(more, work, path, "2"))[2] == ("failed", None, 1)  # a new version does all anew


def test_names_by_shape(spark):
    from textloom.operators import recognise

    texts = {
        1: "The Acme Group hired Dr. Jane Roe in (Paris) yesterday. She met NATO staff in Berlin, then Bank of England people.",
        2: None, 3: "", 4: "lower case only", 5: "CEO Tim Cook\nand Global Widget Ltd. said Q3 2024 was good. He left", 6: "(Élodie Martin) PDF", 7: "saw New York and IBM Research",
    }
    out = recognise.names(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), {"known_loc": ["paris"], "acronym": ["pdf"]}).collect()
    assert all(texts[r.doc_id][r.start : r.end].split() == r.text.split() for r in out)
    got = {(r.doc_id, r.text): (r.label, r.reason) for r in out}
    assert got == {
        (1, "Acme Group"): ("ORG", "org_suffix"), (1, "Dr. Jane Roe"): ("PER", "title_and_name"), (1, "Paris"): ("LOC", "known_loc"), (1, "NATO"): ("ORG", "acronym"), (1, "Berlin"): ("LOC", "after_place_word"), (1, "Bank of England"): ("ORG", "of_in_second"),
        (5, "Tim Cook"): ("PER", "two_words"), (5, "Global Widget Ltd"): ("ORG", "org_suffix"), (6, "Élodie Martin"): ("PER", "two_words"), (7, "New York"): ("LOC", "place_of_two"), (7, "IBM Research"): ("ORG", "acronym_in_run"),
    } | {k: v for k, v in got.items() if k == (1, "She")}


def test_only_words_that_may_be_names_are_shuffled(spark):
    from textloom.operators import recognise

    texts = [(1, "the end of the Bank of  England,\tof\nÉire and of it. The A"), (1, "plain words only"), (None, "of Rome"), (2, None), (3, "")]
    got = sorted(map(tuple, recognise.words(spark.createDataFrame(texts, "doc_id int, text string")).drop("row").fillna(-1, ["doc_id"]).collect()))
    assert got == [
        (-1, 0, 0, "of", "Rome", None, None, None), (-1, 1, 3, "Rome", None, "of", 0, None),
        (1, 3, 11, "the", "Bank", "of", 8, "end"), (1, 4, 15, "Bank", "of", "the", 11, "of"), (1, 5, 20, "of", "England,", "Bank", 15, "the"), (1, 6, 24, "England,", "of", "of", 20, "Bank"),
        (1, 7, 33, "of", "Éire", "England,", 24, "of"), (1, 8, 36, "Éire", "and", "of", 33, "England,"), (1, 12, 52, "The", "A", "it.", 48, "of"), (1, 13, 56, "A", None, "The", 52, "it."),
    ]


def test_personal_data_is_found_as_by_a_scan_of_every_place():
    from textloom.operators import pii

    r = random.Random(5)
    bits = ["1", "12", "123", "4567", "(", ")", "+", "-", ".", " ", "a", "Main", "Street", "DE", "FR12", "@", "x.org", "é", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))
        for pattern, _, _, need, start in pii._compiled:
            assert [m.span() for m in pii._matches(text, pattern, need, start)] == [m.span() for m in pattern.finditer(text)], (pattern.pattern, text)


def test_mentions_are_cut_without_a_window(spark):
    from textloom.plans import resolution

    docs = spark.createDataFrame([(1, "Berlin  saw it, it Élan\nIT Rome Paris"), (2, None), (3, "")], "doc_id long, text string")
    out = resolution._mentions(docs)
    assert [tuple(r) for r in out.orderBy("start").select("doc_id", "pos", "start", "end", "text").collect()] == [(1, 0, 0, 6, "Berlin"), (1, 4, 16, 18, "it"), (1, 7, 32, 37, "Paris")]
    assert "Window" not in out._jdf.queryExecution().toString()
