"""Queries over reports and tracks, made of line items, events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors
from textloom.operators import reports, scoring, tracks
from textloom.plans.retrieval import LINES_SQL, lines
from textloom.plans.tables import table

# Signals are lines of orders; a track is the lines of one return flag, but for those of line 1, which are loose.
SIGNALS_SQL = f"""{LINES_SQL}, sg AS (SELECT l_orderkey AS doc_id, l_linenumber AS signal_id, l_quantity / 50 AS confidence, l_partkey % 5 = 0 AS negated, CASE l_returnflag WHEN 'A' THEN 'symbolic' WHEN 'N' THEN 'iconic' ELSE 'hybrid' END AS modality, l_returnflag AS track_id FROM li),
ts AS (SELECT doc_id, track_id, signal_id FROM sg WHERE signal_id > 1), tk AS (SELECT DISTINCT doc_id, track_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 || track_id END AS identity_id FROM sg)"""
# Mentions: the chains of gold are lines of one return flag of an order, those of pred of one status; some are of one side only, some have no extent.
MENTIONS_SQL = f"""{LINES_SQL}, mt AS (SELECT 'gold' AS side, l_orderkey AS doc_id, l_returnflag AS chain_id, l_linenumber * 10 AS start, l_linenumber * 10 + l_partkey % 4 AS "end" FROM li WHERE l_partkey % 11 > 0
UNION ALL SELECT 'pred', l_orderkey, l_linestatus, l_linenumber * 10, l_linenumber * 10 + l_partkey % 4 FROM li WHERE l_partkey % 7 > 0)"""


def _signals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    modality = F.when(F.col("l_returnflag") == "A", "symbolic").when(F.col("l_returnflag") == "N", "iconic").otherwise("hybrid")
    sg = lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("signal_id"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_partkey") % 5 == 0).alias("negated"), modality.alias("modality"), F.col("l_returnflag").alias("track_id"))
    identity = F.when(F.col("doc_id") % 3 > 0, F.concat(F.col("doc_id") % 7, "track_id"))
    return sg, sg.filter("signal_id > 1").select("doc_id", "track_id", "signal_id"), sg.select("doc_id", "track_id", identity.alias("identity_id")).distinct()


def _mentions(s: SparkSession, d: str) -> DataFrame:
    li, start = lines(s, d), F.col("l_linenumber") * 10
    side = lambda name, chain, rest: li.filter(F.col("l_partkey") % rest > 0).select(F.lit(name).alias("side"), F.col("l_orderkey").alias("doc_id"), F.col(chain).alias("chain_id"), start.alias("start"), (start + F.col("l_partkey") % 4).alias("end"))
    return side("gold", "l_returnflag", 11).unionByName(side("pred", "l_linestatus", 7))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def document_statistics(s, d):
    return _rounded(tracks.document_stats(*_signals(s, d)), "avg_confidence", "avg_track_size")


def linked_tracks(s, d):
    return tracks.linked(_signals(s, d)[2])


def unlinked_tracks(s, d):
    return tracks.unlinked(_signals(s, d)[2]).select("doc_id", "track_id")


def untracked_in_documents(s, d):
    sg, ts, _ = _signals(s, d)
    return sg.join(ts.select("doc_id", "signal_id"), ["doc_id", "signal_id"], "left_anti").select("doc_id", "signal_id")


def _track_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(s, d, "orders")
    held = o.select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("track_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("signal_id"))
    tk = held.select("track_id").distinct().select("track_id", F.concat(F.lit("s"), "track_id").alias("surface"), F.concat(F.lit("t"), F.col("track_id") % 3).alias("type"))
    groups = tk.filter((F.col("track_id") / 10).cast("long") % 4 == 0).select((F.col("track_id") / 10).cast("long").alias("c"), "track_id").select((-F.col("c")).alias("target"), "track_id", (F.col("track_id") % 10).alias("place"))
    return held, tk, groups


def merged_track_signals(s, d):
    return tracks.merge_tracks(*_track_tables(s, d))[0]


def merged_tracks(s, d):
    return tracks.merge_tracks(*_track_tables(s, d))[1]


def _tags(s: SparkSession, d: str, marks: str) -> DataFrame:
    kind = F.when(F.col("l_quantity") > 25, "X").otherwise("Y")
    mark = F.substring(F.lit(marks), (F.col("l_partkey") % len(marks) + 1).cast("int"), F.lit(1))
    return lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(mark == "O", "O").otherwise(F.concat(mark, F.lit("-"), kind)).alias("tag"))


def bio_repair_promote(s, d):
    return tracks.repair_tags(_tags(s, d, "OBII"), "IOB2")


def bio_repair_discard(s, d):
    return tracks.repair_tags(_tags(s, d, "OBII"), "IOB2", discard=True)


def bioes_repair(s, d):
    return tracks.repair_tags(_tags(s, d, "OBIES"), "IOBES")


def span_candidates(s, d):
    docs = table(s, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.length("n_name").alias("n_tokens"))
    return tracks.span_candidates(docs, 3)


def filtered_candidates(s, d):
    docs = table(s, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.length("n_name").alias("n_tokens"))
    mask = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("pos")).withColumn("weight", (F.col("doc_id") * 7 + F.col("pos") * 3) % 10 / 10)
    return tracks.filtered_candidates(docs, mask, 4, 0.5)


def translated_offsets(s, d):
    subs = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(t, ("raw_start", "raw_end", "pseudo_start", "pseudo_end"), strict=True))) for t in ((10, 20, 10, 16), (30, 33, 26, 40), (60, 70, 67, 68))))
    p = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 80).alias("a"), (F.col("p_partkey") % 80 + F.col("p_size") % 9 + 1).alias("b"))
    return p.select("p_partkey", tracks.translate_span(F.col("a"), F.col("b"), subs).alias("x")).select("p_partkey", F.coalesce("x.start", F.lit(-1)).alias("start"), F.coalesce("x.end", F.lit(-1)).alias("end"))


def party_forms(s, d):
    c = F.col("c_name")
    raw = F.element_at(F.array(F.concat(F.lit("Monsieur Jean "), F.upper(c)), F.concat(F.lit("Mme "), c, F.lit(" Durand")), F.concat(F.lit("Société "), c, F.lit(" SARL au capital de 10 euros")), F.concat(c, F.lit(" SAS")), F.concat(F.lit(" "), c)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", tracks.party_form(raw).alias("form"))


def layered_entities(s, d):
    li = lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("p"))
    return tracks.union_layers([li.filter(F.col("p") % k == 0) for k in (2, 3, 5)])


def chunked_matches(s, d):
    return tracks.chunked_extraction(table(s, d, "documents"), "[0-9]+", 300, 80).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


def _entities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = lines(s, d)
    entities = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("label"), F.concat(F.lit("Part "), F.col("l_partkey") % 50).alias("text"))
    relations = li.filter("l_linenumber > 1").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("head_idx"), F.col("l_linenumber").alias("tail_idx"), F.col("l_linestatus").alias("relation"))
    return entities, relations


def knowledge_graph_nodes(s, d):
    return tracks.knowledge_graph(*_entities(s, d))[0]


def knowledge_graph_edges(s, d):
    return tracks.knowledge_graph(*_entities(s, d))[1]


def triggered_events(s, d):
    lexicon = s.createDataFrame([("said", "speech"), ("the", "article"), ("der", "article"), ("tion", "noise"), ("and", "link")], "trigger string, kind string")
    return tracks.events_by_trigger(table(s, d, "documents"), lexicon).groupBy("kind", "trigger").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def coref_b_cubed_heads(s, d):
    m = _mentions(s, d).withColumns({"head_start": F.col("start"), "head_end": F.col("start") + 1})
    return _rounded(reports.b_cubed_heads(m), "precision", "recall", "f1")


def coref_chain_strata(s, d):
    return reports.chain_strata(_mentions(s, d)).select("stratum", "gold_chains")


def coref_zero_anaphors(s, d):
    return reports.zero_anaphors(_mentions(s, d))


def _type_scores(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    parts = scoring.long_tail(p, "p_brand")
    f1 = p.groupBy(F.col("p_brand").alias("class")).agg((F.count_if(F.col("p_size") > 25) / F.count(F.lit(1))).alias("f1"))
    return parts.join(f1, "class")


def long_tail_report(s, d):
    return _rounded(reports.long_tail_report(_type_scores(s, d)), "head_f1", "mid_f1", "tail_f1", "head_tail_gap", "gini")


def temporal_bias(s, d):
    names = table(s, d, "orders").select((F.dayofyear("o_orderdate") / 30).cast("int").alias("decade"), F.when(F.col("o_custkey") % 3 == 0, "f").when(F.col("o_custkey") % 3 == 1, "m").alias("gender"), (F.col("o_totalprice") > 150000).alias("recognised"))
    return _rounded(reports.decade_gaps(names), "rate", "rate_f", "rate_m", "gap")


def few_shot_summary(s, d):
    runs = table(s, d, "events").select((F.col("user_id") % 6).alias("shots"), (F.col("event_id") % 1000 / 1000).alias("f1"))
    return _rounded(reports.shots_summary(runs), "mean", "std")


def _ood(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") / 50).alias("confidence"))
    return reports.out_of_distribution(p.filter("id % 3 = 0"), p.filter("id % 40 = 1"))


def out_of_distribution(s, d):
    return _ood(s, d).select("id", F.round("coverage", 6).alias("coverage"), F.array_join("flags", ",").alias("flags"))


def out_of_distribution_report(s, d):
    return _rounded(reports.out_of_distribution_report(_ood(s, d)), "ood_rate", "ood_confidence", "id_confidence")


def dataset_difficulty(s, d):
    p = table(s, d, "part").select((F.col("p_partkey") % 70).alias("doc_id"), F.col("p_brand").alias("label"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return _rounded(reports.difficulty(reports.annotation_stats(p, p.select("doc_id").distinct())), "length_mean", "length_std", "diversity", "per_example")


def dataset_comparison(s, d):
    t = table(s, d, "documents")
    return _rounded(reports.compare_vocabularies(t.filter("doc_id % 2 = 0"), t.filter("doc_id % 2 = 1")), "vocabulary_overlap", "length_difference")


def discourse_counts(s, d):
    nouns = s.createDataFrame([(n,) for n in ("the", "and", "fact", "der")], "noun string")
    return reports.discourse_counts(table(s, d, "documents"), nouns)


def ensemble_agreement(s, d):
    return _rounded(reports.agreement(lines(s, d).select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("label"))), "unanimous", "pair_agreement")


def label_overlap(s, d):
    p = table(s, d, "part")
    return _rounded(reports.label_overlap(p.filter("p_size > 45").select(F.col("p_type").alias("label")), p.filter("p_size < 4").select(F.col("p_type").alias("label"))), "overlap")


def domain_shift(s, d):
    t = table(s, d, "documents")
    return _rounded(reports.domain_shift(t.filter("lang = 'en' and doc_id % 5 = 0"), t.filter("lang = 'en' and doc_id % 5 > 0")), "oov_rate", "oov_types")


def confidence_spread(s, d):
    return _rounded(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("x")).select("l_orderkey", vectors.sample_std_share(F.transform("x", lambda v: v * 10)).alias("spread")), "spread")


QUERIES = {f.__name__: f for f in (
    document_statistics, linked_tracks, unlinked_tracks, untracked_in_documents, merged_track_signals, merged_tracks, bio_repair_promote, bio_repair_discard, bioes_repair, span_candidates, filtered_candidates, translated_offsets, party_forms, layered_entities, chunked_matches,
    knowledge_graph_nodes, knowledge_graph_edges, triggered_events, coref_b_cubed_heads, coref_chain_strata, coref_zero_anaphors, long_tail_report, temporal_bias, few_shot_summary, out_of_distribution, out_of_distribution_report, dataset_difficulty, dataset_comparison,
    discourse_counts, ensemble_agreement, label_overlap, domain_shift, confidence_spread,
)}

_heads = f"""{MENTIONS_SQL}, m AS (SELECT DISTINCT ON (side, doc_id, start) side, doc_id, chain_id, start FROM mt), g AS (SELECT * FROM m WHERE side = 'gold'), p AS (SELECT * FROM m WHERE side = 'pred'),
gn AS (SELECT doc_id, chain_id, count(*) AS n FROM g GROUP BY ALL), pn AS (SELECT doc_id, chain_id, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT g.doc_id, g.chain_id AS gc, p.chain_id AS pc, count(*) AS n FROM g JOIN p USING (doc_id, start) GROUP BY ALL)"""
_tag = lambda marks: f"{LINES_SQL}, tg AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, substr('{marks}', (l_partkey % {len(marks)} + 1)::INT, 1) AS m, CASE WHEN l_quantity > 25 THEN 'X' ELSE 'Y' END AS k FROM li), tt AS (SELECT *, CASE m WHEN 'O' THEN 'O' ELSE m || '-' || k END AS tag, lag(m) OVER w AS pm, lag(CASE m WHEN 'O' THEN NULL ELSE k END) OVER w AS pk, last_value(CASE m WHEN 'I' THEN NULL ELSE m END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS non_i FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
_bad = "m = 'I' AND (coalesce(pm, 'O') = 'O' OR pk IS DISTINCT FROM k)"
_merge = """o AS (SELECT o_custkey * 10 + o_orderkey % 3 AS track_id, o_orderkey AS signal_id, o_custkey AS c FROM orders), g AS (SELECT DISTINCT -c AS target, track_id, track_id % 10 AS place FROM o WHERE c % 4 = 0)"""
_words = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
_ood_sql = """p AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text, p_size / 50 AS confidence FROM part), te AS (SELECT * FROM p WHERE id % 3 = 0), tr AS (SELECT * FROM p WHERE id % 40 = 1),
gr AS (SELECT DISTINCT id, id % 3 = 0 AS te, id % 40 = 1 AS tr, substr(lower(text), i, 3) AS g FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM p)), kn AS (SELECT DISTINCT g FROM gr WHERE tr),
co AS (SELECT id, count_if(g IN (SELECT g FROM kn)) / count(*) AS coverage FROM gr WHERE te GROUP BY 1),
fl AS (SELECT te.*, coverage, list_filter([CASE WHEN coverage < 0.5 THEN 'low_vocab_coverage' END, CASE WHEN coverage < 0.8 AND lower(text) NOT IN (SELECT lower(text) FROM tr) THEN 'unseen_entity' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS flags FROM te JOIN co USING (id))"""
_slug = lambda e: f"regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
ORACLE = {
    "document_statistics": f"""WITH {SIGNALS_SQL}, a AS (SELECT doc_id, count(*) AS signal_count, round(avg(confidence), 6) AS avg_confidence, count_if(negated)::BIGINT AS negated_count, count_if(modality = 'symbolic')::BIGINT AS symbolic_count, count_if(modality = 'iconic')::BIGINT AS iconic_count, count_if(modality = 'hybrid')::BIGINT AS hybrid_count, count_if(signal_id = 1)::BIGINT AS untracked_count FROM sg GROUP BY 1),
n AS (SELECT tk.*, (SELECT count(*) FROM ts WHERE ts.doc_id = tk.doc_id AND ts.track_id = tk.track_id) AS n FROM tk), b AS (SELECT doc_id, count(*) AS track_count, count(DISTINCT identity_id) AS identity_count, count(identity_id) AS linked_track_count, round(avg(n), 6) AS avg_track_size, count_if(n = 1)::BIGINT AS singleton_count FROM n GROUP BY 1)
SELECT * FROM a JOIN b USING (doc_id)""",
    "linked_tracks": f"WITH {SIGNALS_SQL} SELECT * FROM tk WHERE identity_id IS NOT NULL",
    "unlinked_tracks": f"WITH {SIGNALS_SQL} SELECT doc_id, track_id FROM tk WHERE identity_id IS NULL",
    "untracked_in_documents": f"WITH {SIGNALS_SQL} SELECT doc_id, signal_id FROM sg WHERE signal_id = 1",
    "merged_track_signals": f"WITH {_merge} SELECT track_id, signal_id AS position, signal_id FROM o WHERE c % 4 > 0 UNION ALL SELECT -c, row_number() OVER (PARTITION BY c ORDER BY signal_id) - 1, signal_id FROM o WHERE c % 4 = 0",
    "merged_tracks": f"WITH {_merge}, t AS (SELECT DISTINCT track_id, c FROM o) SELECT track_id, 's' || track_id AS surface, 't' || (track_id % 3) AS type FROM t WHERE c % 4 > 0 UNION ALL SELECT -c, 's' || min(track_id), 't' || (min(track_id) % 3) FROM t WHERE c % 4 = 0 GROUP BY c",
    "bio_repair_promote": f"WITH {_tag('OBII')} SELECT doc_id, pos, CASE WHEN {_bad} THEN 'B-' || k ELSE tag END AS tag FROM tt",
    "bio_repair_discard": f"WITH RECURSIVE {_tag('OBII')}, n AS (SELECT doc_id, pos, m, k, tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM tt), w AS (SELECT doc_id, r, pos, CASE m WHEN 'I' THEN 'O' ELSE tag END AS tag FROM n WHERE r = 1 UNION ALL SELECT n.doc_id, n.r, n.pos, CASE WHEN n.m = 'I' AND (w.tag = 'O' OR w.tag[3:] <> n.k) THEN 'O' ELSE n.tag END FROM w JOIN n ON n.doc_id = w.doc_id AND n.r = w.r + 1) SELECT doc_id, pos, tag FROM w",
    "bioes_repair": f"WITH {_tag('OBIES')} SELECT doc_id, pos, CASE WHEN m IN ('I', 'E') AND coalesce(non_i, 'O') <> 'B' THEN 'S-' || k ELSE tag END AS tag FROM tt",
    "span_candidates": "SELECT n_nationkey AS doc_id, a::INT AS start, b::INT AS \"end\" FROM nation, LATERAL (SELECT unnest(range(0, length(n_name))) AS a), LATERAL (SELECT unnest(range(a + 1, least(a + 3, length(n_name)) + 1)) AS b)",
    "filtered_candidates": "SELECT n_nationkey AS doc_id, a::INT AS start, b::INT AS \"end\" FROM nation, LATERAL (SELECT unnest(range(0, length(n_name))) AS a), LATERAL (SELECT unnest(range(a + 1, least(a + 4, length(n_name)) + 1)) AS b) WHERE (n_nationkey * 7 + a * 3) % 10 >= 5",
    "translated_offsets": """WITH p AS (SELECT p_partkey, p_partkey % 80 AS a, p_partkey % 80 + p_size % 9 + 1 AS b FROM part)
SELECT p_partkey, CASE WHEN b <= 10 OR a >= 20 AND b <= 30 OR a >= 33 AND b <= 60 OR a >= 70 THEN a + d WHEN a >= 10 AND b <= 20 THEN 10 WHEN a >= 30 AND b <= 33 THEN 26 WHEN a >= 60 AND b <= 70 THEN 67 ELSE -1 END::BIGINT AS start,
CASE WHEN b <= 10 OR a >= 20 AND b <= 30 OR a >= 33 AND b <= 60 OR a >= 70 THEN b + d WHEN a >= 10 AND b <= 20 THEN 16 WHEN a >= 30 AND b <= 33 THEN 40 WHEN a >= 60 AND b <= 70 THEN 68 ELSE -1 END::BIGINT AS "end"
FROM (SELECT *, CASE WHEN a >= 70 THEN -4 + 11 - 9 WHEN a >= 33 THEN -4 + 11 WHEN a >= 20 THEN -4 ELSE 0 END AS d FROM p)""",
    "party_forms": f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'person:' || {_slug('upper(c_name)')} || '_jean' WHEN 1 THEN 'person:durand_' || {_slug('c_name')} ELSE 'org:' || {_slug('c_name')} END AS form FROM customer",
    "layered_entities": f"WITH {LINES_SQL}, l AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, l_linenumber + 2 AS \"end\", l_returnflag AS label, k, [2, 3, 5][k + 1] AS q, l_partkey FROM li, range(3) t(k)) SELECT doc_id, start, \"end\", label, min(k)::INT AS layer, count(*) AS votes FROM l WHERE l_partkey % q = 0 GROUP BY ALL",
    "knowledge_graph_nodes": f"WITH {LINES_SQL}, e AS (SELECT l_returnflag AS label, l_partkey % 50 AS t FROM li) SELECT lower(label) || ':part_' || t AS id, label, 'Part ' || t AS name, count(*) AS mentions FROM e GROUP BY ALL",
    "knowledge_graph_edges": f"WITH {LINES_SQL}, e AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, lower(l_returnflag) || ':part_' || (l_partkey % 50) AS id, l_linestatus AS type FROM li) SELECT a.id AS from_id, b.id AS to_id, b.type, count(*) AS weight FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.id <> b.id GROUP BY ALL",
    "triggered_events": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}'']+'), lambda x: x <> '') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS trigger, generate_subscripts(w, 1) - 1 AS pos FROM w) SELECT kind, trigger, count(*) AS n, min(pos)::INT AS \"first\" FROM x JOIN (VALUES ('said', 'speech'), ('the', 'article'), ('der', 'article'), ('tion', 'noise'), ('and', 'link')) l(trigger, kind) USING (trigger) GROUP BY ALL",
    "coref_b_cubed_heads": f"WITH {_heads}, s AS (SELECT sum(c.n * c.n / pn.n) / sum(c.n) AS p, sum(c.n * c.n / gn.n) / sum(c.n) AS r FROM c JOIN gn ON gn.doc_id = c.doc_id AND gn.chain_id = gc JOIN pn ON pn.doc_id = c.doc_id AND pn.chain_id = pc) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s",
    "coref_chain_strata": f"WITH {MENTIONS_SQL}, n AS (SELECT doc_id, chain_id, count(*) AS n FROM mt WHERE side = 'gold' GROUP BY ALL) SELECT unnest(['long', 'short', 'singleton']) AS stratum, unnest([count_if(n > 10), count_if(n BETWEEN 2 AND 10), count_if(n = 1)])::BIGINT AS gold_chains FROM n",
    "coref_zero_anaphors": f"""WITH {MENTIONS_SQL}, z AS (SELECT DISTINCT doc_id, start, "end" FROM mt WHERE start = "end"),
b AS (SELECT DISTINCT a.side, a.doc_id, a.start, x.start AS s, x."end" AS e FROM mt a JOIN mt x ON x.side = a.side AND x.doc_id = a.doc_id AND x.chain_id = a.chain_id AND x."end" <= a.start AND x.start < a.start WHERE a.start = a."end"),
k AS (SELECT z.*, EXISTS (SELECT 1 FROM b WHERE side = 'gold' AND b.doc_id = z.doc_id AND b.start = z.start) AS g, EXISTS (SELECT 1 FROM b WHERE side = 'pred' AND b.doc_id = z.doc_id AND b.start = z.start) AS p,
EXISTS (SELECT 1 FROM b b1 JOIN b b2 ON b1.doc_id = b2.doc_id AND b1.start = b2.start AND b1.s = b2.s AND b1.e = b2.e WHERE b1.side = 'gold' AND b2.side = 'pred' AND b1.doc_id = z.doc_id AND b1.start = z.start) AS c FROM z)
SELECT count_if(g AND p AND c)::BIGINT AS tp, count_if(g AND p AND NOT c)::BIGINT AS wrong_link, count_if(NOT g AND p)::BIGINT AS fp, count_if(g AND NOT p)::BIGINT AS fn, count_if(g)::BIGINT AS gold_anaphors, count_if(p)::BIGINT AS pred_anaphors FROM k""",
    "long_tail_report": """WITH t AS (SELECT p_brand AS c, count(*) AS n, count_if(p_size > 25) / count(*) AS f1 FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c) AS k, count(*) OVER () AS a, row_number() OVER (ORDER BY f1, c) AS o FROM t),
x AS (SELECT *, CASE WHEN k <= ceil(a * 0.2) THEN 'h' WHEN k > a - ceil(a * 0.2) THEN 't' ELSE 'm' END AS part FROM r)
SELECT round(avg(f1) FILTER (part = 'h'), 6) AS head_f1, round(avg(f1) FILTER (part = 'm'), 6) AS mid_f1, round(avg(f1) FILTER (part = 't'), 6) AS tail_f1, round(avg(f1) FILTER (part = 'h') - avg(f1) FILTER (part = 't'), 6) AS head_tail_gap,
round((2 * sum(o * f1) - (count(*) + 1) * sum(f1)) / (count(*) * sum(f1)), 6) AS gini, count_if(f1 < 0.5)::BIGINT AS struggling, count_if(f1 < 0.01)::BIGINT AS failed FROM x""",
    "temporal_bias": "WITH n AS (SELECT floor(dayofyear(o_orderdate) / 30)::INT AS decade, o_custkey % 3 AS g, (o_totalprice > 150000)::INT AS r FROM orders) SELECT decade, count(*) AS n, round(avg(r), 6) AS rate, round(avg(r) FILTER (g = 0), 6) AS rate_f, round(avg(r) FILTER (g = 1), 6) AS rate_m, round(abs(avg(r) FILTER (g = 0) - avg(r) FILTER (g = 1)), 6) AS gap FROM n GROUP BY 1",
    "few_shot_summary": "SELECT user_id % 6 AS shots, count(*) AS tasks, round(avg(event_id % 1000 / 1000), 6) AS mean, round(stddev_samp(event_id % 1000 / 1000), 6) AS std FROM events GROUP BY 1",
    "out_of_distribution": f"WITH {_ood_sql} SELECT id, round(coverage, 6) AS coverage, array_to_string(flags, ',') AS flags FROM fl",
    "out_of_distribution_report": f"WITH {_ood_sql} SELECT count(*) AS entities, count_if(len(flags) > 0)::BIGINT AS ood, round(count_if(len(flags) > 0) / count(*), 6) AS ood_rate, round(coalesce(avg(confidence) FILTER (len(flags) > 0), 0), 6) AS ood_confidence, round(coalesce(avg(confidence) FILTER (len(flags) = 0), 0), 6) AS id_confidence FROM fl",
    "dataset_difficulty": """WITH e AS (SELECT p_partkey % 70 AS doc_id, p_brand AS label, p_type || ' ' || p_name AS text FROM part), s AS (SELECT count(DISTINCT label) AS types, count(*) AS entities, avg(len(string_split(trim(text), ' '))) AS length_mean, stddev_pop(len(string_split(trim(text), ' '))) AS length_std, count(DISTINCT lower(text)) / count(*) AS diversity, count(DISTINCT doc_id) AS examples FROM e),
x AS (SELECT *, entities / examples AS per_example, round(CASE WHEN types > 10 THEN 0.2 WHEN types > 5 THEN 0.1 ELSE 0.0 END + CASE WHEN length_mean > 3 THEN 0.2 ELSE 0.0 END + CASE WHEN length_std > 2 THEN 0.1 ELSE 0.0 END + CASE WHEN diversity > 0.9 THEN 0.2 WHEN diversity < 0.3 THEN -0.1 ELSE 0.0 END + CASE WHEN entities / examples < 1 THEN 0.1 ELSE 0.0 END, 6)::DOUBLE AS sc FROM s)
SELECT types, entities, round(length_mean, 6) AS length_mean, round(length_std, 6) AS length_std, round(diversity, 6) AS diversity, examples, round(per_example, 6) AS per_example, greatest(0.0, least(sc, 1.0)) AS score, CASE WHEN sc < 0.2 THEN 'easy' WHEN sc < 0.4 THEN 'medium' WHEN sc < 0.6 THEN 'hard' ELSE 'very hard' END AS difficulty FROM x""",
    "dataset_comparison": f"""WITH w AS (SELECT doc_id % 2 AS side, {_words} AS w FROM documents), v AS (SELECT unnest(w) AS x, side FROM w), u AS (SELECT x, count(DISTINCT side) AS k FROM v GROUP BY 1)
SELECT round((SELECT count_if(k = 2) / count(*) FROM u), 6) AS vocabulary_overlap, round(avg(len(w)) FILTER (side = 0) - avg(len(w)) FILTER (side = 1), 6) AS length_difference FROM w""",
    "discourse_counts": "WITH c AS (SELECT doc_id, text, lower(text) AS t FROM documents), n AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '[^\\p{L}]+')) AS w FROM c) WHERE w IN ('the', 'and', 'fact', 'der') GROUP BY 1) SELECT c.doc_id, (" + " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in reports.ANAPHORS) + ")::BIGINT AS anaphors, coalesce(k, 0) AS shell_nouns, greatest(len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')), 1)::INT AS sentences FROM c LEFT JOIN n USING (doc_id)",
    "ensemble_agreement": f"WITH {LINES_SQL}, c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM li GROUP BY ALL), i AS (SELECT l_orderkey, count(*) AS labels, sum(n) AS votes, sum(n * (n - 1)) AS same FROM c GROUP BY 1) SELECT count(*) AS items, round(count_if(labels = 1) / count(*), 6) AS unanimous, round(sum(same) / sum(votes * (votes - 1)), 6) AS pair_agreement FROM i",
    "label_overlap": "WITH a AS (SELECT DISTINCT p_type FROM part WHERE p_size > 45), b AS (SELECT DISTINCT p_type FROM part WHERE p_size < 4) SELECT round((SELECT count(*) FROM a SEMI JOIN b USING (p_type)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS overlap",
    "domain_shift": "WITH w AS (SELECT doc_id % 5 = 0 AS te, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS w FROM documents WHERE lang = 'en'), c AS (SELECT w, count(*) AS n, w NOT IN (SELECT w FROM w WHERE NOT te) AS oov FROM w WHERE te GROUP BY 1) SELECT sum(n)::BIGINT AS words, round(sum(n) FILTER (oov) / sum(n), 6) AS oov_rate, round(count_if(oov) / count(*), 6) AS oov_types FROM c",
    "chunked_matches": "SELECT doc_id, t AS text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS t FROM documents) GROUP BY ALL",
    "confidence_spread": "SELECT l_orderkey, round(CASE WHEN count(*) <= 1 THEN 0.0 ELSE least(stddev_samp(l_discount * 10) / 0.5, 1.0) END, 6)::DOUBLE AS spread FROM lineitem GROUP BY 1",
}
