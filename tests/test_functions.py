"""Scalar functions against hand-worked values and properties."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import language, legal, strings, validators, vectors

short = st.text(alphabet="abcdé ", max_size=8)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@given(short, short)
@settings(max_examples=150, deadline=None)
def test_similarities_are_bounded_and_symmetric(a, b):
    for f in (strings._jaro, strings._winkler):
        assert 0 <= f(a, b) <= 1 and (a != b or f(a, b) == 1)
    assert abs(strings._jaro(a, b) - strings._jaro(b, a)) < 1e-9
    assert strings._osa(a, b) == strings._osa(b, a) <= strings._weighted(a, b, 1, 1, 1) <= max(len(a), len(b))
    assert strings._wild("*", b) == 0 and strings._wild(a, a) == 0 and strings._wild("?" * len(b), b) == 0


def test_known_distances():
    assert strings._osa("ca", "abc") == 3 and strings._osa("ab", "ba") == 1
    assert round(strings._winkler("abcd", "abxy"), 4) == round(2 / 3 + 0.2 / 3, 4)
    assert strings._weighted("", "abc", 2, 1, 1) == 6 and strings._wild("a*d", "abcd") == 0


def test_string_columns(spark):
    lit = F.lit
    assert one(spark, strings.normalized_distance(lit(""), lit(""))) == 0
    assert one(spark, strings.string_similarity(lit("Acme Corp"), lit("acme"))) == 0.8
    assert one(spark, strings.multilingual_similarity(lit("東京都"), lit("東京"))) == 0.5
    assert one(spark, strings.track_similarity(lit("Anna's house"), lit("anna house"))) == 1
    assert one(spark, strings.canonical_entity(lit("Me. Dupönt  & Cie"), lit("ORG"), {"me dupont cie": "dupont"})) == "ent:ORG:dupont"
    assert one(spark, strings.fts_query(lit("contrat \"Dupont\" -l'an- 2026"))) == '"contrat" AND "Dupont" AND "l\'an" AND "2026"'
    assert one(spark, strings.fts_query(lit("!? /"))) is None
    assert one(spark, strings.context_window(lit("0123456789"), lit(4), lit(6), 2)) == "234567"
    for text, want in (("He", "pronominal"), ("the man", "nominal"), ("Anna", "proper"), ("dog", "nominal")):
        assert one(spark, strings.mention_type(lit(text))) == want


@pytest.mark.parametrize(("text", "lang", "script"), [("", "english", "mixed"), ("straße", "german", "latin"), ("漢字かな", "japanese", "mixed"), ("Привет", "russian", "cyrillic"), ("123", "english", "latin"), ("漢字", "chinese", "cjk")])
def test_language_and_script(spark, text, lang, script):
    assert one(spark, language.detect_language(F.lit(text))) == lang
    assert one(spark, language.detect_script(F.lit(text))) == script


def test_code_switches(spark):
    df = spark.createDataFrame([(1, "Hello there everybody привет всем друзья"), (2, ""), (3, None), (4, "plain")], "doc_id int, text string")
    rows = sorted(tuple(r) for r in language.code_switches(df).collect())
    assert [r[0] for r in rows] == [1, 1, 4] and rows[0][1] == 0 and rows[0][2] == rows[1][1] and rows[1][2] == 40 and rows[1][3] == "russian"


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (validators.luhn, "4111111111111111", "4111111111111112"),
        (validators.iban, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"),
        (validators.pesel, "80051501231", "80051501230"),
        (validators.bsn, "111222333", "111222334"),
        (validators.belgian_register, "85073003328", "85073003329"),
        (validators.nir, "255081416802538", "255081416802539"),
    ],
)
def test_check_digits(spark, check, good, bad):
    assert one(spark, check(F.lit(good))) is True and one(spark, check(F.lit(bad))) is False
    assert one(spark, check(F.lit(""))) is False and one(spark, check(F.lit("x1"))) is False and one(spark, check(F.lit(None).cast("string"))) is None


def test_corsican_number(spark):
    body = 1_85_08_19_168025  # 2A counts as 19
    assert one(spark, validators.nir(F.lit(f"185082A168025{97 - body % 97:02d}"))) is True


def test_shapes(spark):
    assert one(spark, validators.looks_like_address(F.lit("12 Main Street"))) and not one(spark, validators.looks_like_address(F.lit("Main")))
    assert one(spark, validators.looks_like_id(F.lit("A12345"))) and not one(spark, validators.looks_like_id(F.lit("Python3")))
    out = one(spark, validators.validate(F.lit("IBAN"), F.lit("XX"), F.lit(0.5)))
    assert (out.outcome, out.reason) == ("reject", "iban_check")


def test_legal(spark):
    lit = F.lit
    assert one(spark, legal.french_date(lit("le 3 février 2024"))) == date(2024, 2, 3)
    assert one(spark, legal.french_date(lit("31/02/2024"))) is None and one(spark, legal.french_date(lit("1er mai 2024"))) is None
    assert one(spark, legal.amount_cents(lit("soit 1 234,56 € TTC"))) == 123456 and one(spark, legal.amount_cents(lit("50.000 euros"))) == 5_000_000
    assert one(spark, legal.delay_deadline(lit("sous 2 mois"), lit(date(2024, 1, 1)))) == date(2024, 3, 1)
    assert one(spark, legal.siren(lit("n° 123 456 789"))) == "123456789"
    assert one(spark, legal.article_refs(lit("art. 1240 du code civil et art. L. 12 du code civil"), {"code civil": "cc"})) == ["cc:1240", "cc:L.12"]
    assert one(spark, legal.resolve_court(lit("La Cour de cassation"), [("cour de cassation", "cass"), ("cour", "any")])) == "cass"
    due = one(spark, legal.limitation(lit("contractuel"), lit(date(2020, 2, 29)), F.array(lit(date(2019, 1, 1))), lit(date(2025, 2, 28))))
    assert (due.due, due.expired) == (date(2025, 2, 28), True)
    assert one(spark, legal.limitation(lit("none"), lit(date(2020, 1, 1)), F.array(lit(date(2019, 1, 1))), lit(date(2025, 1, 1)))) is None


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine(arr(0.0), arr(1.0))) == 0 and one(spark, vectors.cosine(arr(1.0), arr(1.0, 2.0))) == 0
    assert one(spark, vectors.interval_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6))) == pytest.approx(1 / 3)
    box = lambda *x: tuple(map(F.lit, x))
    assert one(spark, vectors.box_iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    assert one(spark, vectors.combined_confidence(F.lit(0.5), F.lit(0.5), F.lit(0.5))) == pytest.approx(0.5)
    assert one(spark, vectors.sample_std_share(arr(0.1, 0.9))) == 1.0 and one(spark, vectors.sample_std_share(arr(0.1))) == 0
    sig = one(spark, vectors.signature_similarity(vectors.minhash(vectors.shingles(F.lit("Acme"))), vectors.minhash(vectors.shingles(F.lit("aCME")))))
    assert sig == 1
