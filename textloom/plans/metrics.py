"""Queries over further scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import discourse, metrics
from textloom.plans.evaluation import items
from textloom.plans.retrieval import LINES_SQL, lines
from textloom.plans.tables import table


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _rel(s, d, part, flag):
    return lines(s, d).filter(part).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("head"), (F.col("l_partkey") % 5).alias("tail"), flag.alias("relation"))


def extraction_quality(s, d):
    return _r(metrics.extraction_quality(table(s, d, "part"), "p_type", "p_name", F.col("p_size") < 5), "duplicate_rate", "noise_rate")


def length_bias(s, d):
    return _r(metrics.length_bias(table(s, d, "conversations"), "text", F.col("role") == "user"), "rate")


def word_count_bias(s, d):
    return _r(metrics.word_count_bias(table(s, d, "part"), "p_name", F.col("p_size") > 25), "rate")


def group_gap(s, d):
    return _r(metrics.group_gap(items(s, d), "actual", F.col("correct")), "best", "worst", "gap")


def annotator_agreement(s, d):
    return _r(metrics.annotator_agreement(lines(s, d), ["l_orderkey"], "l_returnflag", 4), "span_agreement", "type_agreement", "contention")


def relation_scores(s, d):
    gold = _rel(s, d, F.col("l_linestatus") == "F", F.col("l_returnflag"))
    predicted = _rel(s, d, F.col("l_quantity") > 15, F.lower("l_returnflag"))
    return _r(metrics.relation_scores(gold, predicted, undirected=True), "precision", "recall", "f1")


def bridging_scores(s, d):
    gold, predicted = _rel(s, d, F.col("l_linestatus") == "F", F.col("l_returnflag")), _rel(s, d, F.col("l_quantity") > 15, F.col("l_returnflag"))
    return _r(metrics.bridging_scores(gold, predicted, ["doc_id", "head", "tail"]), "precision", "recall", "f1")


def compare_entities(s, d):
    a, b = (table(s, d, "lineitem").filter(F.col("l_linestatus") == x).select("l_partkey", "l_returnflag") for x in ("F", "O"))
    return _r(metrics.compare(a, b, ["l_partkey", "l_returnflag"]), "jaccard")


def window_fragmentation(s, d):
    m = lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_partkey") % 3).alias("gold"), F.when(F.col("l_quantity") > 5, (F.col("l_quantity") > 25).cast("int")).alias("pred"))
    return metrics.window_fragmentation(m, 4, 1)


def learning_curve(s, d):
    return _r(metrics.learning_curve(table(s, d, "part"), "p_size", "p_retailprice"), "slope", "intercept", "r2")


def robustness(s, d):
    return _r(metrics.robustness(table(s, d, "events"), "event_type", "value", "click"), "mean", "clean", "kept")


def singleton_reasons(s, d):
    return metrics.singleton_reasons(table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.when(F.col("l_returnflag") == "A", "Part ").otherwise("part "), F.col("l_partkey") % 40).alias("text"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def tag_transitions(s, d):
    return discourse.tag_counts(lines(s, d), "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")[0]


def rule_coreference(s, d):
    m = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.posexplode(F.filter(F.split("text", " "), lambda w: w.rlike("^[A-Z]"))).alias("k", "text"), (F.col("turn") * 1000).alias("t"))
    return discourse.resolve(m.select("doc_id", (F.col("t") + F.col("k")).alias("idx"), F.regexp_replace("text", r"[^\p{L}]", "").alias("text"), F.lit("PER").alias("type")))


QUERIES = {f.__name__: f for f in (
    extraction_quality, length_bias, word_count_bias, group_gap, annotator_agreement, relation_scores, bridging_scores, compare_entities, window_fragmentation, learning_curve, robustness, singleton_reasons, tag_transitions, rule_coreference,
)}
_rel_sql = f"{LINES_SQL}, g AS (SELECT l_orderkey AS d, l_partkey % 3 AS h, l_partkey % 5 AS t, lower(l_returnflag) AS r FROM li WHERE l_linestatus = 'F'), p AS (SELECT l_orderkey AS d, l_partkey % 3 AS h, l_partkey % 5 AS t, lower(l_returnflag) AS r FROM li WHERE l_quantity > 15)"
_PRONOUN_SQL = ", ".join(f"'{w}'" for w in discourse.PRONOUNS)
ORACLE = {
    "rule_coreference": f"""WITH RECURSIVE t AS (SELECT conv_id AS d, turn, list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Z]')) AS ws FROM conversations),
m AS (SELECT d, turn * 1000 + k - 1 AS idx, regexp_replace(word, '[^\\p{{L}}]', '', 'g') AS text FROM (SELECT d, turn, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM t)),
p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY idx, text) - 1 AS pos, lower(text) AS low, text <> '' AND lower(text) NOT IN ({_PRONOUN_SQL}) AS named FROM m),
f AS (SELECT d, text, any_value(low) AS low, min(pos) AS pos FROM p WHERE named GROUP BY d, text),
e AS (SELECT a.d, a.pos AS a, b.pos AS b FROM f a JOIN f b ON a.d = b.d AND a.pos <> b.pos AND (a.low = b.low OR a.text = b.text[1] OR b.text = a.text[1])),
r(d, pos, root) AS (SELECT d, pos, pos FROM f UNION SELECT e.d, e.a, r.root FROM r JOIN e ON e.d = r.d AND e.b = r.pos WHERE r.root < e.a),
c AS (SELECT d, pos, min(root) AS root FROM r GROUP BY d, pos),
n AS (SELECT p.*, c.root FROM p LEFT JOIN f ON p.named AND f.d = p.d AND f.text = p.text LEFT JOIN c ON c.d = f.d AND c.pos = f.pos),
l AS (SELECT *, last_value(root IGNORE NULLS) OVER (PARTITION BY d ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS near FROM n)
SELECT d AS doc_id, idx, coalesce(root, CASE WHEN low IN ({", ".join(f"'{w}'" for w, k in discourse.PRONOUN_TYPES.items() if k != "ORG")}) THEN near END, pos) AS chain FROM l""",
    "tag_transitions": f"WITH {LINES_SQL}, p AS (SELECT l_returnflag AS tag, coalesce(lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 'START') AS prev FROM li) SELECT prev, tag, count(*) AS n FROM p GROUP BY ALL",
    "extraction_quality": "WITH c AS (SELECT count(*) AS n, count_if(p_size < 5) AS z FROM part GROUP BY p_type, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g'))) SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS duplicates, sum(z)::BIGINT AS noisy, round(sum(n - 1) / sum(n), 6) AS duplicate_rate, round(sum(z) / sum(n), 6) AS noise_rate FROM c",
    "length_bias": "SELECT CASE WHEN length(text) <= 5 THEN 'very_short' WHEN length(text) <= 15 THEN 'short' WHEN length(text) <= 30 THEN 'medium' WHEN length(text) <= 50 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n, round(avg((role = 'user')::INT), 6) AS rate FROM conversations GROUP BY 1",
    "word_count_bias": "SELECT least(len(regexp_split_to_array(trim(p_name), '\\s+')), 4)::INT AS words, count(*) AS n, round(avg((p_size > 25)::INT), 6) AS rate FROM part GROUP BY 1",
    "group_gap": "WITH r AS (SELECT avg((l_tax > 0.03)::INT) AS rate FROM lineitem GROUP BY l_returnflag) SELECT count(*) AS groups, round(max(rate), 6) AS best, round(min(rate), 6) AS worst, round(max(rate) - min(rate), 6) AS gap FROM r",
    "annotator_agreement": f"WITH {LINES_SQL}, c AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY l_orderkey, l_returnflag), s AS (SELECT sum(n) AS v, count(*) AS k, max(n) AS m FROM c GROUP BY l_orderkey) SELECT count(*) AS spans, round(avg((v >= 4)::INT), 6) AS span_agreement, round(avg((v >= 4 AND k = 1)::INT), 6) AS type_agreement, round(avg(1 - m / 4), 6) AS contention FROM s",
    "relation_scores": f"WITH {_rel_sql}, gc AS (SELECT d, least(h, t) AS a, greatest(h, t) AS b, r, count(*) AS g FROM g GROUP BY ALL), pc AS (SELECT d, least(h, t) AS a, greatest(h, t) AS b, r, count(*) AS p FROM p GROUP BY ALL), x AS (SELECT sum(least(coalesce(g, 0), coalesce(p, 0)))::BIGINT AS hit, sum(coalesce(g, 0))::BIGINT AS gold, sum(coalesce(p, 0))::BIGINT AS predicted FROM gc FULL JOIN pc USING (d, a, b, r)) SELECT *, round(hit / predicted, 6) AS precision, round(hit / gold, 6) AS recall, round(2 * (hit / predicted) * (hit / gold) / (hit / predicted + hit / gold), 6) AS f1 FROM x",
    "bridging_scores": f"WITH {_rel_sql}, x AS (SELECT (SELECT count_if((d, h, t) IN (SELECT (d, h, t) FROM g)) / count(*) FROM p) AS precision, (SELECT count_if((d, h, t) IN (SELECT (d, h, t) FROM p)) / count(*) FROM g) AS recall) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM x",
    "compare_entities": "WITH c AS (SELECT count_if(l_linestatus = 'F') AS a, count_if(l_linestatus = 'O') AS b FROM lineitem GROUP BY l_partkey, l_returnflag) SELECT round(count_if(a > 0 AND b > 0) / count(*), 6) AS jaccard, sum(least(a, b))::BIGINT AS unchanged, sum(greatest(b - a, 0))::BIGINT AS added, sum(greatest(a - b, 0))::BIGINT AS removed FROM c WHERE a + b > 0",
    "window_fragmentation": f"WITH {LINES_SQL}, c AS (SELECT count(DISTINCT l_linenumber // 3) AS w, count(DISTINCT CASE WHEN l_quantity > 5 THEN (l_quantity > 25)::INT END) AS p, count_if(l_quantity <= 5) AS m FROM li GROUP BY l_orderkey, l_partkey % 3) SELECT count(*) AS chains, count_if(w > 1)::BIGINT AS spanning, count_if(w > 1 AND p > 1)::BIGINT AS fragmented, sum(m)::BIGINT AS missing FROM c",
    "learning_curve": "SELECT round(regr_slope(p_retailprice, ln(p_size)), 6) AS slope, round(regr_intercept(p_retailprice, ln(p_size)), 6) AS intercept, round(regr_r2(p_retailprice, ln(p_size)), 6) AS r2 FROM part",
    "robustness": "WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1), c AS (SELECT avg(value) AS clean FROM events WHERE event_type = 'click') SELECT event_type, round(mean, 6) AS mean, round(clean, 6) AS clean, round(mean / clean, 6) AS kept FROM m, c",
    "singleton_reasons": "WITH t AS (SELECT l_orderkey AS d, CASE WHEN l_returnflag = 'A' THEN 'Part ' ELSE 'part ' END || (l_partkey % 40) AS x FROM lineitem), o AS (SELECT d, lower(x) AS t, min(x) AS x FROM t GROUP BY ALL HAVING count(*) = 1), s AS (SELECT lower(x) AS t, count(DISTINCT d) AS k FROM t GROUP BY 1) SELECT CASE WHEN starts_with(x, 'p') THEN 'generic' WHEN k > 1 THEN 'likely_missed' ELSE 'unique_name' END AS reason, count(*) AS n FROM o JOIN s USING (t) GROUP BY 1",
}
