"""Queries over stacked spans, cross-document entities, rewritten texts, entity memories, pieces and boxes, the stored index, message trees, diverse rows and fan-out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import diversity, fanout, index, islands, matching, messages, pii, recognise, resolve, rewriting, spans
from textloom.plans.retrieval import BM25_SQL, SPAN_SQL, line_spans
from textloom.plans.tables import shares, table
from textloom.storage import fresh_path, stash
from textloom.streaming import entities

# -- spans


def _layers(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("label") == "A", "MONEY").when(F.col("label") == "N", "PER").otherwise("MISC")
    return line_spans(s, d).withColumn("label", label).withColumn("layer", (F.col("id") % 3).cast("int"))


def _stacked(strategy: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return islands.stack(_layers(s, d), ["k"], strategy)

    query.__name__ = f"stacked_{strategy}"
    return query


_LAYERS_SQL = f"{SPAN_SQL}, la AS (SELECT k, id, s, e, CASE label WHEN 'A' THEN 'MONEY' WHEN 'N' THEN 'PER' ELSE 'MISC' END AS label, confidence, (id % 3)::INT AS layer FROM sp WHERE s < e)"


def _stack_sql(strategy: str) -> str:
    if strategy == "union":
        return f"WITH {_LAYERS_SQL} SELECT k, id, s AS start, e AS \"end\", label, confidence, layer FROM la"
    size = {"longest": "lambda h: h.e - h.s", "confidence": "lambda h: h.confidence"}.get(strategy)
    best = "hits[1]" if strategy == "priority" else f"hits[list_position(list_transform(hits, {size}), list_max(list_transform(hits, {size})))]"
    better = {"priority": "false", "longest": "x.e - x.s > best.e - best.s", "confidence": "x.confidence > best.confidence"}[strategy]
    kind = "STRUCT(n BIGINT, k BIGINT, id INTEGER, s BIGINT, e BIGINT, label VARCHAR, confidence DOUBLE, layer INTEGER)[]"
    return f"""WITH RECURSIVE {_LAYERS_SQL},
c AS (SELECT k, n, {{'n': n, 'k': k, 'id': id, 's': s, 'e': e, 'label': label, 'confidence': confidence, 'layer': layer}} AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer, s, e, id, label, confidence) AS n FROM la)),
run(k, n, kept) AS (
  SELECT DISTINCT k, 0::BIGINT, []::{kind} FROM c
  UNION ALL
  SELECT k, n, CASE WHEN len(hits) = 0 THEN list_append(kept, x) ELSE list_transform(list_filter(kept, lambda y: NOT (y.s < x.e AND y.e > x.s) OR y.n = best.n),
    lambda y: CASE WHEN y.n = best.n AND ((x.s <= best.s AND x.e >= best.e AND x.label = 'MONEY' AND best.label = 'MISC') OR {better}) THEN x ELSE y END) END
  FROM (SELECT *, {best} AS best FROM (SELECT c.k, c.n, c.x, r.kept, list_filter(r.kept, lambda y: y.s < c.x.e AND y.e > c.x.s) AS hits FROM run r JOIN c ON c.k = r.k AND c.n = r.n + 1))),
last AS (SELECT kept FROM run QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1),
f AS (SELECT unnest(kept) AS y FROM last)
SELECT y.k AS k, y.id AS id, y.s AS start, y.e AS "end", y.label AS label, y.confidence AS confidence, y.layer AS layer FROM f"""


_STRATEGIES = ("first", "confidence", "longer_same_type", "shortest")


def deduped_spans(s, d):
    out = None
    for strategy in _STRATEGIES:
        kept = spans.dedup_overlapping(line_spans(s, d), ["k"], strategy).select(F.lit(strategy).alias("strategy"), "k", "id", "start", "end", "label")
        out = kept if out is None else out.unionByName(kept)
    return out


def _dedup_sql() -> str:
    order = {"first": "s, -confidence, e, label, id", "confidence": "-confidence, s, e, label, id", "longer_same_type": "s - e, s, e, label, id, -confidence", "shortest": "e - s, s, e, label, id, -confidence"}
    parts = " UNION ALL ".join(f"SELECT '{t}' AS strategy, *, row_number() OVER (PARTITION BY k ORDER BY {o}) AS n FROM sp" for t, o in order.items())
    return f"""WITH RECURSIVE {SPAN_SQL}, c AS ({parts}),
run(strategy, k, n, kept) AS (
  SELECT DISTINCT strategy, k, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT, label VARCHAR, id INTEGER)[] FROM c
  UNION ALL
  SELECT c.strategy, c.k, c.n, CASE WHEN len(list_filter(r.kept, lambda y: y.s < c.e AND y.e > c.s AND (c.strategy <> 'longer_same_type' OR y.label = c.label))) > 0 THEN r.kept ELSE list_append(r.kept, {{'s': c.s, 'e': c.e, 'label': c.label, 'id': c.id}}) END
  FROM run r JOIN c ON c.strategy = r.strategy AND c.k = r.k AND c.n = r.n + 1),
last AS (SELECT strategy, k, unnest(kept) AS y FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY strategy, k ORDER BY n DESC) = 1))
SELECT strategy, k, y.id AS id, y.s AS start, y.e AS "end", y.label AS label FROM last"""


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = line_spans(s, d).select("k", "id", "start", "end", "label").distinct()
    return own.filter("id % 2 = 1"), own.filter("id % 2 = 0")


def gold_matches(s, d):
    gold, predicted = _sides(s, d)
    return islands.match(gold, predicted, "k").fillna(-1, ["gold_start", "gold_end", "start", "end"])


_MATCH_SQL = f"""SELECT k, gold_label, label, class, coalesce(gold_start, -1) AS gold_start, coalesce(gold_end, -1) AS gold_end, coalesce(start, -1) AS start, coalesce("end", -1) AS "end" FROM (
WITH RECURSIVE {SPAN_SQL}, u AS (SELECT DISTINCT k, id, s, e, label FROM sp),
g AS (SELECT k, s, e, label, row_number() OVER (PARTITION BY k ORDER BY s, e, label) AS n FROM u WHERE id % 2 = 1),
p AS (SELECT k, list({{'n': n, 's': s, 'e': e, 'label': label}} ORDER BY n) AS ps FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, label) AS n FROM u WHERE id % 2 = 0) GROUP BY k),
run(k, n, used, gs, ge, gl, best) AS (
  SELECT DISTINCT k, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::STRUCT(rank INTEGER, n BIGINT) FROM g
  UNION ALL
  SELECT k, n, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.n) END, s, e, label, b
  FROM (SELECT g.k, g.n, g.s, g.e, g.label, r.used, list_min(list_transform(list_filter(p.ps, lambda y: y.s < g.e AND y.e > g.s AND NOT list_contains(r.used, y.n)),
      lambda y: {{'rank': (CASE WHEN y.s = g.s AND y.e = g.e THEN 0 ELSE 2 END + CASE WHEN y.label = g.label THEN 0 ELSE 1 END)::INTEGER, 'n': y.n}})) AS b
    FROM run r JOIN g ON g.k = r.k AND g.n = r.n + 1 LEFT JOIN p ON p.k = g.k)),
pe AS (SELECT k, unnest(ps) AS y FROM p)
SELECT r.k, r.gs AS gold_start, r.ge AS gold_end, r.gl AS gold_label, pe.y.s AS start, pe.y.e AS "end", pe.y.label AS label,
  CASE r.best.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'exact_boundary' WHEN 2 THEN 'partial' WHEN 3 THEN 'overlap' ELSE 'none' END AS class
FROM run r LEFT JOIN pe ON pe.k = r.k AND pe.y.n = r.best.n WHERE r.n > 0
UNION ALL
SELECT k, NULL, NULL, NULL, y.s, y.e, y.label, 'spurious' FROM pe WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.k = pe.k AND r.best.n = pe.y.n))"""

# -- names by their shape


def recognised_names(s, d):
    return recognise.names(table(s, d, "documents"), {"acronym": ["pdf"]}).select("doc_id", "start", "end", "text", "label", "confidence", "reason")


def _in(kind: str, what: str) -> str:
    return f"({what}) IN ({', '.join(repr(w) for w in recognise.WORDS[kind])})"


_BARE = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
_LETTERS = r"regexp_replace({}, '[^\p{{L}}]', '', 'g')"


def _shouted(w: str) -> str:
    return f"(length({_LETTERS.format(w)}) >= 2 AND upper({_LETTERS.format(w)}) = {_LETTERS.format(w)})"


_NAMES_SQL = rf"""WITH t AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\x0B\f\r]') AS ws FROM documents)),
u AS (SELECT *, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 - length(word))::INT AS start FROM t),
v AS (SELECT *, {_BARE.format("word")} AS plain, lower({_BARE.format("word")}) AS low, regexp_matches(word, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') AS cap FROM u WHERE word <> ''),
w AS (SELECT *, lead(low) OVER o AS next_low, lead(cap) OVER o AS next_cap, lag(word) OVER o AS before, lag(start) OVER o AS before_start, lag(word, 2) OVER o AS before2 FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT *, regexp_matches(word, '[)\]}}.!?]$') AND NOT coalesce({_in("suffix", "next_low")}, false) AS ends FROM w),
y AS (SELECT *, (cap AND NOT {_in("trade", "low")}) OR (lower(word) IN ('of', 'the') AND coalesce(next_cap, false) AND NOT ends) AS inside FROM x),
z AS (SELECT *, NOT inside OR NOT coalesce(lag(inside) OVER o, false) OR coalesce(lag(ends) OVER o, false) AS fresh FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM z),
f AS (SELECT *, min(CASE WHEN cap AND NOT {_in("opener", "low")} THEN pos END) OVER (PARTITION BY doc_id, run) AS first FROM r WHERE inside),
g AS (SELECT doc_id, run, list({{'start': start, 'word': word, 'plain': plain, 'low': low, 'before': before, 'bs': before_start, 'before2': before2}} ORDER BY pos) AS w FROM f WHERE pos >= first GROUP BY doc_id, run),
h AS (SELECT *, coalesce({_in("title", "lower(regexp_replace(w[1].before, '[.]+$', ''))")}, false) AS titled, array_to_string(list_transform(w, lambda q: q.low), ' ') AS joined, array_to_string(list_transform(w, lambda q: q.word), ' ') AS said FROM g),
i AS (SELECT *, CASE WHEN titled THEN w[1].bs ELSE w[1].start + length(regexp_extract(w[1].word, '^[^\p{{L}}\p{{N}}]+')) END AS start, w[-1].start + length(w[-1].word) - CASE WHEN titled THEN 0 ELSE length(regexp_extract(w[-1].word, '[^\p{{L}}\p{{N}}]+$')) END AS "end",
  len(w) + titled::INT AS n, w[1].low AS one, CASE WHEN titled THEN w[1].low ELSE w[2].low END AS two, CASE WHEN titled THEN w[1].before2 ELSE w[1].before END AS prior FROM h),
j AS (SELECT *, CASE WHEN regexp_matches(joined, '^q[1-4]( (fy.*|[0-9]+|h1|h2))*$') AND NOT titled THEN 'quarter' WHEN n = 1 AND {_in("title", "one")} THEN 'title_alone' WHEN {_in("suffix", "w[-1].low")} THEN 'org_suffix' WHEN titled THEN 'title_and_name'
  WHEN n >= 2 AND len(list_filter(w, lambda q: {_shouted("q.plain")} AND NOT {_in("trade", "q.low")} AND q.low <> 'pdf')) > 0 THEN 'acronym_in_run' WHEN coalesce({_in("before_place", "lower(prior)")}, false) THEN 'after_place_word'
  WHEN n = 2 AND {_in("place_word", "one")} THEN 'place_of_two' WHEN n = 2 THEN 'two_words' WHEN n > 2 AND two = 'of' THEN 'of_in_second' WHEN n > 2 THEN 'long_run' WHEN length(one) = 1 THEN 'letter'
  WHEN {_shouted("w[1].plain")} AND one = 'pdf' THEN 'known_acronym' WHEN {_shouted("w[1].plain")} THEN 'acronym' WHEN prior IS NULL OR regexp_matches(prior, '[.!?]$') THEN 'opens_sentence' ELSE 'capital' END AS reason FROM i),
ru(reason, label, weight) AS (VALUES {', '.join(f"('{a}', {f"'{b}'" if b else 'NULL'}, {c}::DOUBLE)" for a, b, c in recognise.RULES)})
SELECT doc_id, start::INT AS start, "end"::INT AS "end", CASE WHEN titled THEN w[1].before || ' ' || said ELSE {_BARE.format("said")} END AS text, label, weight AS confidence, reason FROM j JOIN ru USING (reason) WHERE weight >= {recognise.LEAST}"""


def stacked_recognition(s, d):
    """Patterns first, names by shape after them, laid over each other."""
    docs = table(s, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(pii.scan(F.col("text"))).alias("x")).select("doc_id", "x.start", "x.end", F.col("x.type").alias("label"), F.lit(0.95).alias("confidence"), F.lit(0).alias("layer"))
    shaped = recognise.names(docs).select("doc_id", "start", "end", "label", "confidence", F.lit(1).alias("layer"))
    return islands.stack(found.unionByName(shaped), ["doc_id"], "priority")


# -- entities of several documents


def part_entities(s, d):
    p = table(s, d, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string")), F.concat(F.lit("P"), F.floor(F.col("p_retailprice") / 50).cast("string"), F.lit("'s")))
    mentions = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("doc_id"), text.alias("text"), F.col("p_type").alias("type"))
    return resolve.entities(mentions, 0.6).select("id", "cluster", "name", "documents")


_ENTITIES_SQL = """WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey % 97 AS doc_id, p_name || ' ' || p_brand || ' size' || (p_size % 10) || ' P' || floor(p_retailprice / 50)::BIGINT || '''s' AS text, p_type AS type FROM part),
w AS (SELECT id, doc_id, text, type, list_distinct(string_split(regexp_replace(lower(text), '''s$', ''), ' ')) AS w FROM m),
e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.type = b.type AND a.id <> b.id WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6),
r(id, root) AS (SELECT id, id FROM m UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id WHERE r.root < e.a),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id)
SELECT c.id, c.cluster, n.text AS name, count(DISTINCT m.doc_id) OVER (PARTITION BY c.cluster) AS documents FROM c JOIN m ON m.id = c.id JOIN m n ON n.id = c.cluster"""

# -- texts for retrieval


_PRONOUNS = ("it", "itself", "es", "la", "le", "er")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text, doc_id) to (doc_id, pos, start, end, text) of the words, cut at blanks, that may be mentions: pronouns, words with a capital first, and any beyond ASCII."""
    for batch in batches:
        found = [[] for _ in range(5)]
        for text, doc_id in zip(batch.column(0), batch.column(1).to_pylist()):
            words = text.as_py().split(" ")
            starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            at = [k for k, w in enumerate(words) if "A" <= w[:1] <= "Z" or w.lower() in _PRONOUNS or not w.isascii()]
            for column, own in zip(found, ([doc_id] * len(at), at, [starts[k] for k in at], [starts[k + 1] - 1 for k in at], [words[k] for k in at])):
                column += own
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "pos", "start", "end", "text"])


def _mentions(docs: DataFrame) -> DataFrame:
    """Words of documents cut at blanks: capitalised ones as names, pronouns; type by the length's parity."""
    placed = docs.filter("text is not null").select("text", "doc_id").mapInArrow(_cut, "doc_id long, pos int, start long, end long, text string")
    said = F.lower("text").isin(*_PRONOUNS)
    return placed.filter(said | F.col("text").rlike("^[A-Z][a-z]{4,}$")).select("doc_id", "start", "end", "text", F.lit("X").alias("type"), F.when(F.length("text") > 14, F.col("text")).alias("chain"), "pos")


def rewritten_for_retrieval(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return rewriting.self_contained(docs, stash(_mentions(docs), "mentions")).select("doc_id", "rewrites", F.sha2("text", 256).alias("text_sha256"))


_REWRITE_SQL = f"""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
p AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM w),
m AS (SELECT p.doc_id, p.pos, p.word, p.e - length(p.word) AS s, p.e, lower(word) IN ('it', 'itself') AS pronoun, lower(substring(d.text, (p.e + 1)::BIGINT, {rewriting.AHEAD})) AS ahead
  FROM p JOIN documents d USING (doc_id) WHERE lower(word) IN ('it', 'itself', 'es', 'la', 'le', 'er') OR regexp_matches(word, '^[A-Z][a-z]{{4,}}$')),
n AS (SELECT *, last_value(CASE WHEN NOT pronoun THEN {{'s': s, 'e': e, 'word': word}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN NOT pronoun THEN {{'s': s, 'e': e, 'word': word}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m),
x AS (SELECT doc_id, pos, word, CASE WHEN s - b.e <= {rewriting.REACH} THEN b.word WHEN a.s - e <= {rewriting.REACH} THEN a.word END AS new FROM n
  WHERE lower(word) = 'it' AND NOT regexp_matches(ahead, '(?s){rewriting.EMPTY_IT}')),
y AS (SELECT doc_id, pos, CASE WHEN regexp_matches(word, '^[A-Z]') THEN upper(new[1]) || new[2:] ELSE new END AS new FROM x WHERE new IS NOT NULL)
SELECT p.doc_id, count(y.new)::INT AS rewrites, sha256(string_agg(coalesce(y.new, p.word), ' ' ORDER BY p.pos)) AS text_sha256 FROM p LEFT JOIN y USING (doc_id, pos) GROUP BY p.doc_id"""

# -- an entity memory


def entity_memory(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    said = li.join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    mentions = said.select(F.col("l_suppkey").alias("stream_id"), F.col("l_partkey").alias("seq"), F.concat_ws(" ", "p_brand", "p_name").alias("text"))
    return entities.replayed(mentions).select("stream_id", "seq", "entity", "score")


_MEMORY_SQL = """WITH RECURSIVE c AS (SELECT l_suppkey AS k, l_partkey AS seq, lower(p_brand || ' ' || p_name) AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
run(k, n, seq, kept, best, score) AS (
  SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, []::STRUCT(name VARCHAR, forms VARCHAR[])[], NULL::BIGINT, NULL::DOUBLE FROM c
  UNION ALL
  SELECT k, n, seq, CASE WHEN hit IS NULL THEN list_append(kept, {'name': t, 'forms': [t]}) ELSE list_transform(kept, lambda y, i: CASE WHEN i = hit THEN {'name': CASE WHEN length(t) > length(y.name) THEN t ELSE y.name END, 'forms': list_distinct(list_append(y.forms, t))} ELSE y END) END,
    CASE WHEN hit IS NULL THEN len(kept) ELSE hit - 1 END, CASE WHEN hit IS NULL THEN 0 ELSE list_max(fits) END
  FROM (SELECT *, CASE WHEN list_max(fits) >= 0.7 THEN list_position(fits, list_max(fits)) END AS hit FROM (
    SELECT c.k, c.n, c.seq, c.t, r.kept, list_transform(r.kept, lambda y: CASE WHEN c.t = y.name THEN 1.0 WHEN list_contains(y.forms, c.t) THEN 0.95 WHEN contains(y.name, c.t) OR contains(c.t, y.name) THEN 0.85
      WHEN string_split(c.t, ' ')[-1] = string_split(y.name, ' ')[-1] THEN 0.8 WHEN string_split(c.t, ' ')[1] = string_split(y.name, ' ')[1] THEN 0.75 ELSE 0 END::DOUBLE) AS fits
    FROM run r JOIN c ON c.k = r.k AND c.n = r.n + 1)))
SELECT k::VARCHAR AS stream_id, seq, best AS entity, score FROM run WHERE n > 0"""

# -- pieces and boxes


def _fragments(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = line_spans(s, d).select("k", "id", "start", "end", "label").distinct().groupBy("k", "id", "start", "end").agg(F.min("label").alias("label"))
    gold = own.select("k", (F.col("id") % 3).alias("entity"), "label", "start", "end")
    predicted = own.select("k", (F.col("id") % 3).alias("entity"), "label", (F.col("start") + F.col("id") % 2).alias("start"), "end")
    return gold, predicted


def fragment_score(s, d):
    gold, predicted = _fragments(s, d)
    scores = matching.fragment_scores(gold, predicted, "k", parts=shares(table(s, d, "lineitem")))
    return scores.select("gold", "predicted", *(F.round(c, 9).alias(c) for c in scores.columns[2:]))


_FRAGMENT_SQL = f"""WITH {SPAN_SQL}, o AS (SELECT k, id, s, e, min(label) AS label FROM sp GROUP BY ALL),
gr AS (SELECT k, id % 3 AS entity, label, s, e FROM o WHERE s < e), pr AS (SELECT k, id % 3 AS entity, label, s + id % 2 AS s, e FROM o WHERE s + id % 2 < e),
g AS (SELECT k, entity, min(label) AS label, list({{'s': s, 'e': e}} ORDER BY s, e) AS parts, min(s) AS a, max(e) AS b, sum(e - s) AS size FROM gr GROUP BY ALL), p AS (SELECT k, entity, min(label) AS label, list({{'s': s, 'e': e}} ORDER BY s, e) AS parts, min(s) AS a, max(e) AS b, sum(e - s) AS size FROM pr GROUP BY ALL),
x AS (SELECT coalesce(sum(least(m, n)), 0) AS n FROM (SELECT k, label, parts, count(*) AS m FROM g GROUP BY ALL) JOIN (SELECT k, label, parts, count(*) AS n FROM p GROUP BY ALL) USING (k, label, parts)),
y AS (SELECT coalesce(sum(least(m, n)), 0) AS n FROM (SELECT k, label, a, b, count(*) AS m FROM g GROUP BY ALL) JOIN (SELECT k, label, a, b, count(*) AS n FROM p GROUP BY ALL) USING (k, label, a, b)),
h AS (SELECT gr.k, gr.entity AS ge, pr.entity AS pe, sum(least(gr.e, pr.e) - greatest(gr.s, pr.s)) AS shared FROM gr JOIN pr ON gr.k = pr.k AND gr.s < pr.e AND gr.e > pr.s GROUP BY ALL),
z AS (SELECT h.k, ge, pe, 2 * shared / (g.size + p.size) AS v FROM h JOIN g ON g.k = h.k AND g.entity = ge JOIN p ON p.k = h.k AND p.entity = pe WHERE g.label = p.label),
t AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS predicted, (SELECT n FROM x) AS ex, (SELECT n FROM y) AS bo, (SELECT sum(v) FROM (SELECT max(v) AS v FROM z GROUP BY k, ge)) AS re, (SELECT sum(v) FROM (SELECT max(v) AS v FROM z GROUP BY k, pe)) AS pc),
u AS (SELECT gold, predicted, ex / predicted AS xp, ex / gold AS xr, bo / predicted AS bp, bo / gold AS br, pc / predicted AS pp, re / gold AS rr FROM t)
SELECT gold, predicted, round(xp, 9) AS exact_precision, round(xr, 9) AS exact_recall, round(2 * xp * xr / (xp + xr), 9) AS exact_f1, round(bp, 9) AS boundary_precision, round(br, 9) AS boundary_recall, round(2 * bp * br / (bp + br), 9) AS boundary_f1,
  round(pp, 9) AS partial_precision, round(rr, 9) AS partial_recall, round(2 * pp * rr / (pp + rr), 9) AS partial_f1 FROM u"""


def _boxes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A page for each supplier, a box for each of its lines; predicted ones are moved by the line's number."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("page"), F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("label"))
    x, y = (F.col("l_orderkey") * 37 % 1999).cast("double"), (F.col("l_partkey") * 13 % 1499).cast("double")
    wide, high = (F.col("l_orderkey") % 90 + 10).cast("double"), (F.col("l_partkey") % 40 + 8).cast("double")
    move = F.col("l_linenumber").cast("double")
    of = lambda dx: li.select("page", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x0") if dx is None else (x + dx).alias("x0"), y.alias("y0"), (x + wide).alias("x1"), (y + high).alias("y1"), "label", F.concat(F.lit("Part "), (F.col("l_partkey") % 50).cast("string")).alias("text"))
    return of(None), of(move)


def box_overlaps(s, d):
    gold, predicted = _boxes(s, d)
    return matching.box_pairs(gold, predicted, "page").select("page", "id", "id_r", F.round("iou", 9).alias("iou"))


def box_score(s, d):
    gold, predicted = _boxes(s, d)
    scores = matching.box_scores(gold, predicted, "page")
    return scores.select("gold", "predicted", *(F.round(c, 9).alias(c) for c in scores.columns[2:]))


_BOX_SQL = """li AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS page, max(l_partkey) AS l_partkey, max(l_returnflag) AS label FROM lineitem GROUP BY ALL),
g AS (SELECT page, l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 37 % 1999)::DOUBLE AS x0, (l_partkey * 13 % 1499)::DOUBLE AS y0, (l_orderkey * 37 % 1999 + l_orderkey % 90 + 10)::DOUBLE AS x1, (l_partkey * 13 % 1499 + l_partkey % 40 + 8)::DOUBLE AS y1, label, 'part ' || (l_partkey % 50) AS text, l_linenumber FROM li),
p AS (SELECT page, id, x0 + l_linenumber AS x0, y0, x1, y1, label, text FROM g),
pa AS (SELECT g.page, g.id, p.id AS id_r, g.label = p.label AS same, g.text = p.text AS said, (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS sh, (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS ar
  FROM g JOIN p ON g.page = p.page AND g.x0 < p.x1 AND g.x1 > p.x0 AND g.y0 < p.y1 AND g.y1 > p.y0 WHERE g.x0 < g.x1 AND p.x0 < p.x1),
iou AS (SELECT *, sh / (ar - sh) AS iou FROM pa)"""
_BOX_SCORE_SQL = f"""WITH {_BOX_SQL}, n AS (SELECT count(*) AS n FROM g), v AS (SELECT * FROM iou WHERE same),
t AS (SELECT count(*) AS c FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.page = g.page AND p.label = g.label AND p.text = g.text)), b AS (SELECT count(DISTINCT id) AS c FROM v WHERE iou >= 0.5),
o AS (SELECT count(DISTINCT id) AS c FROM (SELECT id FROM v WHERE iou >= 0.5 AND said QUALIFY row_number() OVER (PARTITION BY page, id_r ORDER BY iou DESC, id) = 1))
SELECT n.n AS gold, n.n AS predicted, round((SELECT avg(iou) FROM v), 9) AS mean_iou, round(t.c / n.n, 9) AS text_precision, round(t.c / n.n, 9) AS text_recall, round(t.c / n.n, 9) AS text_f1, round(b.c / n.n, 9) AS box_precision, round(b.c / n.n, 9) AS box_recall, round(b.c / n.n, 9) AS box_f1,
  round(o.c / n.n, 9) AS both_precision, round(o.c / n.n, 9) AS both_recall, round(o.c / n.n, 9) AS both_f1 FROM n, t, b, o"""

# -- a stored index


def indexed_search(s, d):
    """An index written in two batches over the first two thirds of the documents by id; the search adds the rest from their texts."""
    docs = table(s, d, "documents").select("doc_id", "text", F.col("doc_id").alias("added"))
    path = fresh_path(s, "index")
    last = docs.agg(F.max("added")).first()[0] or 0
    for k in (1, 2):
        index.refresh(path, docs.filter(F.col("added") <= last * k // 3))
    asked = s.createDataFrame([("q1", ["the", "tion", "thon"]), ("q2", ["der", "lich"])], "query string, terms array<string>")
    return index.search(path, docs, asked).select("query", "doc_id", F.round("score", 6).alias("score"))


# -- message trees


def _trees(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    block = lambda x: F.array(F.struct(x["text"].alias("text"), F.lit("text").alias("type")))
    shaped = turns.select("conv_id", F.struct(F.transform("t", lambda x: F.struct(block(x).alias("content"), x["role"].alias("role"))).alias("messages"), F.get("t", F.lit(0))["text"].alias("system")).alias("x"))
    return shaped.select(F.col("conv_id").alias("id"), F.parse_json(F.to_json("x")).alias("tree"))


def messages_restored(s, d):
    """Conversations as requests, pseudonymised and restored: their trees as JSON, and whether anything was replaced on the way."""
    vault = s.createDataFrame([], "type string, text string, token string")
    hidden, full = messages.pseudonymise(_trees(s, d), vault)
    back = messages.restore(hidden, full, messages.request_scope)
    return back.select(F.col("id").alias("conv_id"), F.to_json("tree").alias("tree"))


_TREES_SQL = """WITH t AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, to_json({'messages': list_transform(t, lambda x: {'content': [{'text': x.text, 'type': 'text'}], 'role': x.role}), 'system': t[1].text})::VARCHAR AS tree FROM t"""

# -- diverse rows


def diverse_rows(s, d):
    return diversity.farthest_first(table(s, d, "embeddings"), 20).select("rank", "id", F.round("distance", 8).alias("distance"))


_DIVERSE_SQL = """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
r(n, id, v, far, taken, picked, pid, pd) AS (
  SELECT 1, id, v, 1e300::DOUBLE, id = (SELECT min(id) FROM v), (SELECT v FROM v WHERE id = (SELECT min(id) FROM v)), (SELECT min(id) FROM v), NULL::DOUBLE FROM v
  UNION ALL
  SELECT n + 1, id, v, far, taken OR id = b.id, b.v, b.id, b.far FROM (
    SELECT n, id, v, far, taken, first_value({'id': id, 'v': v, 'far': far}) OVER (ORDER BY taken, far DESC, id) AS b FROM (
      SELECT n, id, v, taken, least(far, round(1 - list_cosine_similarity(v, picked), 10)) AS far FROM r WHERE n < 20)))
SELECT DISTINCT n AS rank, pid AS id, round(pd, 8) AS distance FROM r"""

# -- fan-out


def _first_number(text: str | None) -> str:
    found = re.search("[0-9]+", text or "")
    if not found:
        raise ValueError("no number")
    return found.group()


def fanout_outcomes(s, d):
    """Each document's first number; those without one fail, are tried once more and are then set apart."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    path = fresh_path(s, "outcomes")
    fanout.ingest(docs, _first_number, path, "v1", attempts=2)
    return fanout.ingest(docs, _first_number, path, "v1", attempts=2).select("doc_id", "status", "result", "error", "attempts")


_stacks = [_stacked(x) for x in islands.STRATEGIES]
QUERIES = {f.__name__: f for f in (*_stacks, deduped_spans, gold_matches, part_entities, rewritten_for_retrieval, entity_memory, fragment_score, box_overlaps, box_score, indexed_search, messages_restored, diverse_rows, fanout_outcomes, recognised_names, stacked_recognition)}
ORACLE = {f"stacked_{x}": _stack_sql(x) for x in islands.STRATEGIES} | {
    "deduped_spans": _dedup_sql(),
    "recognised_names": _NAMES_SQL,
    "gold_matches": _MATCH_SQL,
    "part_entities": _ENTITIES_SQL,
    "rewritten_for_retrieval": _REWRITE_SQL,
    "entity_memory": _MEMORY_SQL,
    "fragment_score": _FRAGMENT_SQL,
    "box_overlaps": f"WITH {_BOX_SQL} SELECT page, id, id_r, round(iou, 9) AS iou FROM iou",
    "box_score": _BOX_SCORE_SQL,
    "indexed_search": f"WITH {BM25_SQL} SELECT query, doc_id, round(score, 6) AS score FROM bm",
    "messages_restored": _TREES_SQL,
    "diverse_rows": _DIVERSE_SQL,
    "fanout_outcomes": "SELECT doc_id, CASE WHEN n = '' THEN 'quarantined' ELSE 'done' END AS status, nullif(n, '') AS result, CASE WHEN n = '' THEN 'ValueError: no number' END AS error, CASE WHEN n = '' THEN 2 ELSE 1 END::INT AS attempts FROM (SELECT doc_id, regexp_extract(text, '[0-9]+') AS n FROM documents)",
}
