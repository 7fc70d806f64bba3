"""Bands and floors that are taken from the documents themselves."""

import numpy as np

from textloom.llm import language, quality
from textloom.llm.registry import PIECE_MODEL

WORDS = "the market by a river window where people of one station keep their garden and number every story in the morning letter about water paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


def test_short_table_like_junk_goes_and_a_secret_stays(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, 90), "en") for i in range(80)]
    rows += [(i, prose(rng, 900), "en") for i in range(100, 180)]
    rows.append((300, " | ".join(rng.choice(WORDS, 90)) + " |", "en"))
    rows.append((301, prose(rng, 90) + " key sk-9fQ2xL7vBz81KmTqR4wYp0Zs3HdNcE6a at kx.zhqw93@qzv.example.com", "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judge(df, PIECE_MODEL).filter("kept").collect()}
    assert 300 not in kept and 301 in kept
    assert len(kept) >= 158


def test_unlearned_language_and_letter_noise_go(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(60, 200))), "en") for i in range(100)]
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(120))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    rows += [(500, noise, None), (501, finnish * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.recognised(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(100))


def test_rare_language_is_judged_by_wider_bands(spark):
    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, 90), "en") for i in range(80)]
    junk = " | ".join(rng.choice(WORDS, 90)) + " |"
    rows += [(300, junk, "xx"), (301, prose(rng, 90), "xx"), (302, junk, None), (303, "ж" * 3000 + " " + " ".join(f"ω{i}ψ" for i in range(90)), "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judge(df, PIECE_MODEL).filter("kept").collect()}
    assert kept & {300, 301, 302, 303} == {301}
    assert quality.script("É ÿ ª") == "latin" and quality.script("12 ¿ ×") == "latin" and quality.script("12 !") == "other"
