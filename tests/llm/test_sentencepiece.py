"""Max-plus segmentation against the library, for merges and for the same pieces read by best path, and exact round trips."""

import random
from functools import reduce

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from textloom.llm import sentencepiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The same file with the model type set to best path (1) instead of merges (2)."""
    out = b""
    for number, value in S._fields(open(PATH, "rb").read()):
        if number == 2:
            rest = b""
            for n, v in S._fields(value):
                if n == 3:
                    v = 1
                rest += varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | (2 if n not in SINGLE else 5)) + (varint(len(v)) if n not in SINGLE else b"") + v
            value = rest
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


SINGLE = {10, 15}  # trainer fields that are single floats
TEXTS = ["", "Hello world", " two  blanks ", "línea\nnueva\n\n fin", "日本語のテキスト🙂🙂", "tab\there", "a" * 300, "x" * 50 + " " * 40, "Éçan ouèque!!! 123,456.78", "\n", " "]


def unigram():
    return S.Model(list(S._fields(open(PATH, "rb").read())))


def test_best_path_is_the_librarys(library):
    own = unigram()
    for t in TEXTS:
        ids, score = own.encode(t)
        theirs = library.encode(t)
        assert own.decode(ids.tolist()) == t
        if list(ids) != theirs:  # two best paths: the totals agree
            total = sum(library.get_score(k) for k in theirs if not library.is_byte(k))
            assert sum(library.get_score(int(k)) for k in ids if not library.is_byte(int(k))) == total
    merged = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in TEXTS[1:5]:  # merges never find a better path
        assert own.encode(t)[1] >= sum(own_score(own, merged, k) for k in merged.encode(t)) - 1e-6 or any(map(merged.is_byte, merged.encode(t)))
        assert merged.decode(own.encode(t)[0].tolist()) == t


def own_score(own, lib, k):
    return lib.get_score(k)


def random_texts(seed, n, most):
    rng = random.Random(seed)
    for _ in range(n):
        signs = rng.choice(["ab", "aeiou rst", "0123456789abcdef", "ACGT", "abcdefghijklmnopqrstuvwxyz ", "▁ a\n", "éü日本x🙂 ", "<s>/ab ", "  \tthe in", "łżźć ő", "\u0000\u200d\ufeff a"])
        yield "".join(rng.choice(signs) for _ in range(rng.randint(1, most)))


def test_merges_are_the_librarys():
    own, theirs = S.read(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert isinstance(own, S.Merges)
    texts = [t for (t,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for t in [*TEXTS, *texts, *random_texts(5, 1500, 90)]:
        ids, score = own.encode(t)
        assert ids.tolist() == theirs.encode(t)
        assert abs(score - sum(theirs.get_score(k) for k in ids.tolist())) < 1e-3 or any(map(theirs.is_byte, ids.tolist()))
        assert own.decode(ids.tolist()) == t or "▁" in t


@pytest.mark.parametrize("read", [unigram, lambda: S.read(PATH)])
@pytest.mark.parametrize("size", [17, 40, 200])
def test_chunks_give_the_whole(size, read):
    own = read()
    for t in [" ".join(TEXTS), "q" * 700, "nowordbreakshere" * 40, "hex0123" * 90, *random_texts(size, 12, 900)]:
        s = own.marked(t)
        parts = S.chunks(own, s, size)
        assert "".join(x[lead : lead + n] for x, lead, n, _ in parts) == s
        matrices = [own.transfer(*x, k == len(parts) - 1) for k, x in enumerate(parts)]
        total = reduce(S.product, matrices)[0][0]
        outer = [reduce(S.product, matrices[i : i + 3]) for i in range(0, len(matrices), 3)]
        above = S.boundary_states(outer)  # down a tree of two levels
        at = [0] + [x for i, (a, b) in enumerate(zip(above, above[1:], strict=False)) for x in S.boundary_states(matrices[3 * i : 3 * i + 3], a, b)[1:]]
        got = [i for k, (x, a, b) in enumerate(zip(parts, at, at[1:], strict=False)) for i in own.trace(*x, k == len(parts) - 1, a, b)]
        assert total == sum(own.segment(w)[1] for w in own.words(s)) and got == own.encode(t)[0].tolist()


def test_product_is_associative():
    rng = random.Random(3)
    a, b, c = ([[rng.choice([S.NONE, rng.randint(-99, 0)]) for _ in range(5)] for _ in range(5)] for _ in range(3))
    assert S.product(S.product(a, b), c) == S.product(a, S.product(b, c))


def test_encode_and_decode(spark):
    giant = "größe und länge " * 60
    rows = [(1, giant), (2, "short"), (None, None), (3, ""), (1, giant), (4, "wordwithoutend" * 500), (5, "has ▁ mark")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")
    got = S.encode(df, PATH, giant=400, chunk=64)
    assert got.columns == ["doc_id", "ids", "n_tokens", "score", "round_trip"]
    own = S.read(PATH)
    key = lambda r: str((r[0], list(r[1])))
    have = sorted(got.collect(), key=key)
    want = sorted(((a, own.encode(b or "")[0].tolist(), own.encode(b or "")[1]) for a, b in rows), key=key)
    for h, w in zip(have, want, strict=True):
        assert (h.doc_id, list(h.ids), h.n_tokens) == (w[0], w[1], len(w[1])) and abs(h.score - w[2]) < 1e-6
        assert h.round_trip == (h.doc_id != 5)
    texts = {r.doc_id: r.text for r in S.decode(got, PATH).collect()}
    assert texts[1] == giant and texts[4] == "wordwithoutend" * 500 and texts[None] == ""
    assert S.encode(df.limit(0), PATH).count() == 0
