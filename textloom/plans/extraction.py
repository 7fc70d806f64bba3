"""Queries over extraction, signals and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import extract, signals, store
from textloom.plans.tables import table

RULES = [("cheap", "high", "(?i)cheap", None), ("bets", "medium", "(?i)bets", None), ("query", "low", r"\?", "utm_source")]


def page_text(s, d):
    return table(s, d, "pages").select("page_id", F.length(extract.html_text(F.col("html"))).alias("n"), (F.locate("<", extract.html_text(F.col("html"))) > 0).alias("tagged"))


def pattern_entities(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(extract.pattern_entities(F.col("text"))).alias("x")).select("doc_id", "x.*")


def lexicon_entities(s, d):
    lexicon = s.createDataFrame([("of the", "A"), ("der", "B"), ("la", "B")], "term string, type string")
    return extract.lexicon_entities(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), lexicon, 2)


def special_categories(s, d):
    return table(s, d, "documents").select("doc_id", F.size(extract.special_categories(F.col("text"))).cast("long").alias("n"))


def national_ids(s, d):
    digits = F.concat(F.lit("n "), F.lpad(F.col("o_orderkey").cast("string"), 11, "4"), F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 9, "2"))
    return table(s, d, "orders").select("o_orderkey", F.size(extract.national_ids(digits)).cast("long").alias("n"))


def ensemble_votes(s, d):
    spans = table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("source"), F.col("l_returnflag").alias("type"), F.lit(0.5).alias("confidence"))
    return extract.vote(spans, ["l_orderkey"], {"s0": 2.0, "s1": 1.0}).withColumn("confidence", F.round("confidence", 6))


def url_rules(s, d):
    return extract.apply_rules(table(s, d, "pages"), RULES, "page_id", "url")


def clause_audit(s, d):
    checks = s.createDataFrame([("en", "a", "the"), ("en", "b", "thon"), ("fr", "a", "elle"), ("fr", "b", "xyz")], "doc_type string, clause string, phrase string")
    return extract.clause_audit(table(s, d, "documents"), checks, "lang")


def compound_filter(s, d):
    r = table(s, d, "customer").select(F.col("c_custkey").alias("signal_id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("surface"), (F.col("c_acctbal") / 10000).alias("confidence"), F.col("c_nationkey").alias("start"), (F.col("c_nationkey") + 2).alias("end"))
    return r.filter(signals.matching(label="BUILDING", text="CUSTOMER#", least=0.2, span=(3, 20))).select("signal_id")


def untracked_signals(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("signal_id"))
    return signals.untracked(c, table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("signal_id")))


def track_statistics(s, d):
    o = table(s, d, "orders")
    sig = o.select(F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("surface"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"), F.lit(0.5).alias("confidence"))
    return signals.track_stats(sig, o.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("signal_id")))


def table_merge(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    batch = o.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 3).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))
    return store.merge(o, batch, ["o_orderkey"], "o_orderstatus")


def retry_state(s, d):
    status = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("pending").alias("status"), F.lit(1).alias("attempts"), F.lit("").alias("last_error")).filter("doc_id % 2 = 0")
    failed = table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit("late").alias("error"))
    return store.mark_pending(status, failed)


QUERIES = {f.__name__: f for f in (
    page_text, pattern_entities, lexicon_entities, special_categories, national_ids, ensemble_votes, url_rules, clause_audit, compound_filter, untracked_signals, track_statistics, table_merge, retry_state,
)}
_nat = "WITH k AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 11, '4') AS p, lpad(o_orderkey::VARCHAR, 9, '2') AS b FROM orders)"


def _sum(value, weights):
    return " + ".join(f"substr({value}, {k}, 1)::INT * {w}" for k, w in enumerate(weights, 1))



def _html_sql(html: str) -> str:
    """extract.html_text step by step; a script and a style element are two patterns here."""
    out = html
    for pattern, new in ((r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "), (r"(?i)</(?:p|div|li|h[1-6]|tr|article|section|nav)>|<br\s*/?>", "\n"), (r"<[^>]*>", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    for pattern, new in ((r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"), (r"^\n|\n$", "")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out}, ' ')"


ORACLE = {
    "page_text": f"WITH t AS (SELECT page_id, {_html_sql('html')} AS t FROM pages) SELECT page_id, length(t)::INT AS n, contains(t, '<') AS tagged FROM t",
    "lexicon_entities": "WITH w AS (SELECT item_id AS doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark), r AS (SELECT doc_id, i::INT - 1 AS position, n::INT AS words, array_to_string(w[i:i + n - 1], ' ') AS surface FROM w, range(1, 3) t(n), range(1, 2000) p(i) WHERE i + n - 1 <= len(w)) SELECT *, CASE lower(regexp_replace(surface, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) WHEN 'of the' THEN 'A' ELSE 'B' END AS type FROM r WHERE lower(regexp_replace(surface, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) IN ('of the', 'der', 'la')",
    "special_categories": "SELECT doc_id, (" + " + ".join(f"regexp_matches(lower(text), '\\b({'|'.join(w)})\\b')::BIGINT" for w, _ in extract.SPECIAL.values()) + ") AS n FROM documents",
    "national_ids": f"{_nat} SELECT o_orderkey, (((10 - ({_sum('p', [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])}) % 10) % 10 = substr(p, 11, 1)::INT OR 97 - substr(p, 1, 9)::BIGINT % 97 = substr(p, 10, 2)::INT OR 97 - (2000000000 + substr(p, 1, 9)::BIGINT) % 97 = substr(p, 10, 2)::INT)::BIGINT + (({_sum('b', [9, 8, 7, 6, 5, 4, 3, 2, -1])}) % 11 = 0)::BIGINT) AS n FROM k",
    "ensemble_votes": "WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS source, l_returnflag AS type FROM lineitem), t AS (SELECT l_orderkey, type, sum(CASE WHEN source = 0 THEN 2.0 ELSE 1.0 END * 0.5) AS score, count(*) AS votes FROM s GROUP BY ALL), b AS (SELECT l_orderkey, type FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, votes DESC, type) = 1), w AS (SELECT l_orderkey, count(DISTINCT source) AS sources FROM s GROUP BY 1) SELECT l_orderkey, type, sources, round(0.5 * CASE WHEN sources >= 3 THEN 1.5 WHEN sources = 2 THEN 1.2 ELSE 0.95 END, 6)::DOUBLE AS confidence FROM b JOIN w USING (l_orderkey)",
    "url_rules": "SELECT page_id AS doc_id, 'cheap' AS rule, 'high' AS severity FROM pages WHERE regexp_matches(url, '(?i)cheap') UNION ALL SELECT page_id, 'bets', 'medium' FROM pages WHERE regexp_matches(url, '(?i)bets') UNION ALL SELECT page_id, 'query', 'low' FROM pages WHERE contains(url, '?') AND NOT contains(url, 'utm_source')",
    "clause_audit": "WITH c AS (SELECT doc_id, (CASE lang WHEN 'en' THEN contains(lower(text), 'the')::INT + contains(lower(text), 'thon')::INT ELSE contains(lower(text), 'elle')::INT + contains(lower(text), 'xyz')::INT END)::BIGINT AS present FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, present, 2::BIGINT AS required, CASE present WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'missing' END AS status FROM c",
    "compound_filter": "SELECT c_custkey AS signal_id FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), 'customer#') AND c_acctbal / 10000 >= 0.2 AND c_nationkey >= 3 AND c_nationkey + 2 <= 20",
    "untracked_signals": "SELECT c_custkey AS signal_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "track_statistics": "SELECT o_custkey AS track_id, count(*) AS length, count(DISTINCT o_orderpriority) AS variants, max(o_orderkey) - min(o_orderkey) AS spread, min(o_orderkey) AS first, max(o_orderkey) + 1 AS last, 0.5::DOUBLE AS least, 0.5::DOUBLE AS greatest, 0.5::DOUBLE AS mean FROM orders GROUP BY 1",
    "table_merge": "WITH b AS (SELECT DISTINCT o_orderkey + 3 AS o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b",
    "retry_state": "SELECT c_custkey AS doc_id, 'pending' AS status, CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN c_custkey % 3 = 0 THEN 'late' ELSE '' END AS last_error FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
}
