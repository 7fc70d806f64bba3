"""Queries over scalar functions, each with DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import language, legal, strings, validators, vectors
from textloom.plans.tables import table

PAIRS_SQL = "pairs AS (SELECT a.p_partkey AS id, a.p_name || ' ' || a.p_type AS a, b.p_name || ' ' || b.p_type AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name and type with the next part's."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("s"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("b"))
    return part.join(after, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("s").alias("a"), "b")


def edit_distances(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select(
        "id", F.levenshtein(a, b).cast("long").alias("distance"), F.round(strings.normalized_distance(a, b), 6).alias("normalized"), F.round(strings.edit_similarity(a, b), 6).alias("similarity"), F.round(strings.levenshtein_similarity(a, b), 6).alias("by_length")
    )


EDIT_SQL = f"""WITH {PAIRS_SQL} SELECT id, levenshtein(a, b) AS distance, round(2.0 * levenshtein(a, b) / (length(a) + length(b) + levenshtein(a, b)), 6) AS normalized,
round(1 - 2.0 * levenshtein(a, b) / (length(a) + length(b) + levenshtein(a, b)), 6) AS similarity, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS by_length FROM pairs"""


def jaro_similarities(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select("id", F.round(strings.jaro(a, b), 6).alias("jaro"), F.round(strings.jaro_winkler(a, b), 6).alias("jaro_winkler"))


JARO_SQL = f"""WITH {PAIRS_SQL}, j AS (SELECT id, jaro_similarity(a, b) AS j, CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1:1] = b[1:1] THEN 1 ELSE 0 END AS same FROM pairs)
SELECT id, round(j, 6) AS jaro, round(j + same * 0.1 * (1 - j), 6) AS jaro_winkler FROM j"""


def word_similarities(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select("id", F.round(strings.string_similarity(a, b), 6).alias("library"), F.round(strings.track_similarity(a, b), 6).alias("track"), F.round(strings.multilingual_similarity(a, b), 6).alias("multilingual"))


_words = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda x: x <> ''))"
_jac = f"len(list_intersect({_words.format('a')}, {_words.format('b')}))::DOUBLE / len(list_distinct({_words.format('a')} || {_words.format('b')}))"
WORDS_SQL = f"""WITH {PAIRS_SQL} SELECT id, round(CASE WHEN lower(a) = lower(b) THEN 1 WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 0.8 ELSE {_jac} END, 6) AS library,
round({_jac}, 6) AS track, round(CASE WHEN lower(a) = lower(b) THEN 1 ELSE {_jac} END, 6) AS multilingual FROM pairs"""


def character_ngram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    grams = lambda c: strings.char_ngrams(F.lower(F.col(c)), 2)
    return name_pairs(spark, sf).select("id", F.round(strings.jaccard(grams("a"), grams("b")), 6).alias("shared"))


_grams = "list_distinct(list_transform(range(1, length({0})), lambda i: substr(lower({0}), i, 2)))"
GRAMS_SQL = f"WITH {PAIRS_SQL} SELECT id, round(len(list_intersect({_grams.format('a')}, {_grams.format('b')}))::DOUBLE / len(list_distinct({_grams.format('a')} || {_grams.format('b')})), 6) AS shared FROM pairs"


def closest_region(spark: SparkSession, sf: str) -> DataFrame:
    """For each nation the nearest region name by edit distance; ties: the first key. Both tables have a fixed number of rows."""
    regions = table(spark, sf, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("all"))
    ranked = table(spark, sf, "nation").join(F.broadcast(regions)).select("n_nationkey", F.array_min(F.transform("all", lambda r: F.struct(F.levenshtein(F.col("n_name"), r.r_name).alias("d"), r.r_regionkey.alias("k"), r.r_name.alias("name")))).alias("best"))
    return ranked.select("n_nationkey", F.col("best.name").alias("closest"), F.col("best.d").cast("long").alias("distance"))


CLOSEST_SQL = "SELECT n_nationkey, arg_min(r_name, (levenshtein(n_name, r_name), r_regionkey)) AS closest, min(levenshtein(n_name, r_name)) AS distance FROM nation, region GROUP BY n_nationkey"


def within_distance(spark: SparkSession, sf: str, most: int = 4) -> DataFrame:
    """Pairs of nations whose names are within an edit distance."""
    a, b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    d = F.levenshtein(F.col("x"), F.col("y"), most)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("d", d).filter(F.col("d") >= 0).select("a", "b", F.col("d").cast("long").alias("distance"))


WITHIN_SQL = "SELECT p.n_nationkey AS a, q.n_nationkey AS b, levenshtein(p.n_name, q.n_name) AS distance FROM nation p JOIN nation q ON p.n_nationkey < q.n_nationkey WHERE levenshtein(p.n_name, q.n_name) <= 4"


def document_language_votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language.detect_language(F.col("text")).alias("language"))


_votes = ", ".join(f"len(regexp_extract_all(text, '{p}')) * {n} AS {name}" for name, p, n in language.VOTES)
_names = ", ".join(f"'{n}'" for n, _, _ in language.VOTES)
VOTES_SQL = f"""WITH v AS (SELECT doc_id, {_votes} FROM documents), l AS (SELECT doc_id, japanese, [{', '.join(n for n, _, _ in language.VOTES)}] AS c FROM v),
b AS (SELECT doc_id, japanese, list_max(c) AS top, [{_names}][list_position(c, list_max(c))] AS best FROM l)
SELECT doc_id, CASE WHEN top = 0 THEN 'english' WHEN best = 'chinese' AND japanese > 0 THEN 'japanese' ELSE best END AS language FROM b"""


def document_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language.detect_script(F.col("text")).alias("script"))


def code_switch_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.code_switches(table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def mention_types(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "conversations").select("conv_id", "turn", F.element_at(F.split("text", " "), 1).alias("mention"))
    return first.select("conv_id", "turn", strings.mention_type(F.col("mention")).alias("type"))


_pro = ", ".join(f"'{p}'" for p in strings.PRONOUNS)
MENTION_SQL = f"""WITH m AS (SELECT conv_id, turn, string_split(text, ' ')[1] AS m FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(lower(m)) IN ({_pro}) THEN 'pronominal' WHEN regexp_matches(lower(m), '^({'|'.join(strings.DETERMINERS)}) ') THEN 'nominal'
WHEN substr(ltrim(m), 1, 1) <> lower(substr(ltrim(m), 1, 1)) AND substr(ltrim(m), 1, 1) = upper(substr(ltrim(m), 1, 1)) THEN 'proper' ELSE 'nominal' END AS type FROM m"""


def keyword_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", strings.fts_query(F.concat_ws(" '-", "p_name", "p_type")).alias("query"))


FTS_SQL = """WITH t AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ' ''-' || p_type, '[^\\p{L}\\p{N}''-]+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: w <> '')[1:8] AS t FROM part)
SELECT p_partkey, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda w: '"' || w || '"'), ' AND ') END AS query FROM t"""


def character_offsets(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    return table(spark, sf, "documents").select("doc_id", strings.char_to_byte(t, half).cast("long").alias("bytes"), strings.byte_to_char(t, strings.char_to_byte(t, half)).cast("long").alias("chars"))


OFFSETS_SQL = "SELECT doc_id, strlen(substr(text, 1, length(text) // 2)) AS bytes, length(text) // 2 AS chars FROM documents"


def luhn_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", validators.luhn(F.col("o_orderkey").cast("string")).alias("valid"))


LUHN_SQL = """SELECT o_orderkey, list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(s, i, 1)::INT ELSE (substr(s, i, 1)::INT * 2) // 10 + (substr(s, i, 1)::INT * 2) % 10 END)) % 10 = 0 AS valid
FROM (SELECT o_orderkey, reverse(o_orderkey::VARCHAR) AS s FROM orders)"""


def identity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Check digits of made-up numbers: each order key padded to the length of the kind."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", validators.pesel(F.lpad(key, 11, "7")).alias("pesel"), validators.bsn(F.lpad(key, 9, "1")).alias("bsn"), validators.belgian_register(F.lpad(key, 11, "8")).alias("belgian"), validators.nir(F.lpad(key, 15, "1")).alias("nir"), validators.iban(F.concat(F.lit("FR"), F.lpad(key, 25, "3"))).alias("iban")
    )


def _sum(value: str, weights: list[int]) -> str:
    return " + ".join(f"substr({value}, {k}, 1)::INT * {w}" for k, w in enumerate(weights, 1))


CHECKS_SQL = f"""WITH k AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 11, '7') AS p, lpad(o_orderkey::VARCHAR, 9, '1') AS b, lpad(o_orderkey::VARCHAR, 11, '8') AS e, lpad(o_orderkey::VARCHAR, 15, '1') AS n, lpad(o_orderkey::VARCHAR, 25, '3') AS i FROM orders)
SELECT o_orderkey, (10 - ({_sum('p', [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])}) % 10) % 10 = substr(p, 11, 1)::INT AS pesel, ({_sum('b', [9, 8, 7, 6, 5, 4, 3, 2, -1])}) % 11 = 0 AS bsn,
(97 - substr(e, 1, 9)::BIGINT % 97 = substr(e, 10, 2)::INT OR 97 - (2000000000 + substr(e, 1, 9)::BIGINT) % 97 = substr(e, 10, 2)::INT) AS belgian,
97 - substr(n, 1, 13)::BIGINT % 97 = substr(n, 14, 2)::INT AS nir, (substr(i, 3) || '1527' || substr(i, 1, 2))::HUGEINT % 97 = 1 AS iban FROM k"""


def id_and_address_shapes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", validators.looks_like_address(t).alias("address"), validators.looks_like_id(t).alias("id_number"))


SHAPES_SQL = f"""SELECT doc_id, (regexp_matches(text, '[0-9]') AND regexp_matches(text, '{'|'.join(validators.STREETS)}')) OR (regexp_matches(text, '\\b[0-9]{{5}}(?:-[0-9]{{4}})?\\b') AND regexp_matches(text, '{'|'.join(validators.STATES)}')) AS address,
regexp_matches(text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') OR regexp_matches(text, '[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}') OR regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4}}[0-9]{{7}}')
OR (strlen(text) BETWEEN 6 AND 10 AND regexp_matches(text, '^[\\p{{L}}\\p{{N}}]+$') AND len(regexp_extract_all(text, '[0-9]')) * 2 >= strlen(text)) AS id_number FROM documents"""


def french_dates_and_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as French sentences and read back."""
    named = F.element_at(F.array(*(F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"))), F.month("o_orderdate"))
    day = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Le "), F.dayofmonth(day), F.lit(" "), named, F.lit(" "), F.year(day))).otherwise(F.concat(F.lit("du "), F.dayofmonth(day), F.lit("/"), F.month(day), F.lit("/"), F.year(day)))
    delay = F.concat(F.lit("payer sous "), F.col("o_orderkey") % 9 + 1, F.when(F.col("o_orderkey") % 3 == 0, " jours").when(F.col("o_orderkey") % 3 == 1, " mois").otherwise(" ans"))
    money = F.concat(F.lit("la somme de "), F.translate(F.format_string("%.2f", F.col("o_totalprice")), ".", ","), F.lit(" EUR"))
    return table(spark, sf, "orders").select(
        "o_orderkey", legal.french_date(written).cast("string").alias("day"), legal.delay_deadline(delay, F.to_date(day)).cast("string").alias("due"), legal.amount_cents(money).alias("cents"), legal.siren(F.concat(F.lit("SIREN "), F.lpad(F.col("o_orderkey").cast("string"), 9, "4"))).alias("siren")
    )


DATES_SQL = """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, (o_orderdate::DATE + ((o_orderkey % 9 + 1) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 30 ELSE 365 END)::INT)::DATE::VARCHAR AS due,
round(printf('%.2f', o_totalprice)::DOUBLE * 100)::BIGINT AS cents, lpad(o_orderkey::VARCHAR, 9, '4') AS siren FROM orders"""


def limitation_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims: category by priority, the latest shipment interrupts."""
    names = sorted(legal.PERIODS)
    ships = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("ship"))
    claims = table(spark, sf, "orders").join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    category = F.element_at(F.array(*map(F.lit, names), F.lit("inconnue")), (F.col("o_orderkey") % (len(names) + 1) + 1).cast("int"))
    day = F.to_date("o_orderdate")
    found = legal.limitation(category, day, F.array("ship"), F.to_date(F.lit("2000-01-01")))
    return claims.select("o_orderkey", category.alias("category"), found.alias("l")).select("o_orderkey", "category", F.col("l.due").cast("string").alias("due"), F.coalesce("l.expired", F.lit(False)).alias("expired"))


_cat = sorted(legal.PERIODS)
LIMIT_SQL = f"""WITH s AS (SELECT l_orderkey, max(l_shipdate::DATE) AS ship FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, [{', '.join(f"'{c}'" for c in _cat)}, 'inconnue'][o_orderkey % {len(_cat) + 1} + 1] AS category, greatest(o_orderdate::DATE, coalesce(ship, o_orderdate::DATE)) AS start FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
d AS (SELECT *, CASE category {' '.join(f"WHEN '{c}' THEN {legal.PERIODS[c]}" for c in _cat)} END AS years FROM c)
SELECT o_orderkey, category, (start + to_years(years::INT))::DATE::VARCHAR AS due, years IS NOT NULL AND coalesce((start + to_years(years::INT))::DATE <= DATE '2000-01-01', false) AS expired FROM d"""


def cosine_to_first(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    query = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(query)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


COSINE_SQL = "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0"


def interval_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Price bands of neighbouring parts as intervals."""
    part = table(spark, sf, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("s"), (F.floor("p_retailprice") + F.col("p_size")).cast("long").alias("e"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(vectors.interval_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 6).alias("iou"))


IOU_SQL = """WITH p AS (SELECT p_partkey, floor(p_retailprice)::BIGINT AS s, (floor(p_retailprice) + p_size)::BIGINT AS e FROM part)
SELECT a.p_partkey, round(CASE WHEN least(a.e, b.e) <= greatest(a.s, b.s) THEN 0 ELSE (least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / (a.e - a.s + b.e - b.s - (least(a.e, b.e) - greatest(a.s, b.s))) END, 6) AS iou
FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1"""


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(vectors.document_tokens(F.col("text"))).alias("tokens"), F.sum(vectors.column_tokens(F.col("role"), F.col("text"))).alias("column_tokens"))
    return turns.select("conv_id", "tokens", "column_tokens", vectors.support_bin(F.col("tokens") / 1000).alias("bin"))


TOKENS_SQL = """SELECT conv_id, sum((strlen(text) + 32) // 4)::BIGINT AS tokens, sum(strlen(role) // 4 + strlen(text) // 4 + 20)::BIGINT AS column_tokens,
CASE WHEN sum((strlen(text) + 32) // 4) / 1000 >= 0.7 THEN 'high' WHEN sum((strlen(text) + 32) // 4) / 1000 >= 0.4 THEN 'medium' ELSE 'low' END AS bin FROM conversations GROUP BY conv_id"""

QUERIES = {
    "edit_distances": edit_distances, "jaro_similarities": jaro_similarities, "word_similarities": word_similarities, "character_ngram_similarity": character_ngram_similarity, "closest_string": closest_region,
    "within_distance": within_distance, "language_votes": document_language_votes, "script_detection": document_scripts, "code_switch_segments": code_switch_segments, "mention_types": mention_types,
    "keyword_query_terms": keyword_query_terms, "character_offsets": character_offsets, "luhn_check": luhn_of_orders, "identity_checks": identity_checks, "id_and_address_shapes": id_and_address_shapes,
    "french_dates_and_delays": french_dates_and_delays, "limitation_deadlines": limitation_deadlines, "cosine_similarity": cosine_to_first, "interval_iou": interval_overlaps, "token_estimates": token_estimates,
}
ORACLE = {
    "edit_distances": EDIT_SQL, "jaro_similarities": JARO_SQL, "word_similarities": WORDS_SQL, "character_ngram_similarity": GRAMS_SQL, "closest_string": CLOSEST_SQL, "within_distance": WITHIN_SQL, "language_votes": VOTES_SQL,
    "mention_types": MENTION_SQL, "keyword_query_terms": FTS_SQL, "character_offsets": OFFSETS_SQL, "luhn_check": LUHN_SQL, "identity_checks": CHECKS_SQL, "id_and_address_shapes": SHAPES_SQL,
    "french_dates_and_delays": DATES_SQL, "limitation_deadlines": LIMIT_SQL, "cosine_similarity": COSINE_SQL, "interval_iou": IOU_SQL, "token_estimates": TOKENS_SQL,
}
