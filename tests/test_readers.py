"""Readers of annotated corpora on small files of their formats."""

import json

import pytest

from textloom.sources import readers


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_litbank_coref(spark, tmp_path):
    path = write(tmp_path, "a.ann", "MENTION\tT0\t0\t1\t0\t2\tMr Bennet\tPER\tPROP\nMENTION\tT1\t1\t0\t1\t0\the\tPER\tPRON\nMENTION\tT2\t1\t4\t1\t4\tHome\tLOC\tNOM\nCOREF\tT0\tbennet-1\nCOREF\tT1\tbennet-1\n")
    assert rows(readers.read("litbank_coref", spark, path), "mention", "start", "end", "text", "chain") == [("T0", 1, 3, "Mr Bennet", "bennet-1"), ("T1", 0, 1, "he", "bennet-1"), ("T2", 4, 5, "Home", "T2")]


def test_ecb_plus(spark, tmp_path):
    text = """<Document doc_name="1.xml"><token t_id="1" sentence="0" number="0">Quake</token><token t_id="2" sentence="0" number="1">hits</token><token t_id="3" sentence="0" number="2">town</token>
<Markables><ACTION_OCCURRENCE m_id="7" ><token_anchor t_id="2"/></ACTION_OCCURRENCE><NON_HUMAN_PART m_id="8" ><token_anchor t_id="1"/>
<token_anchor t_id="3"/></NON_HUMAN_PART><ACTION_OCCURRENCE m_id="9" RELATED_TO="" TAG_DESCRIPTOR="t1" /></Markables>
<Relations><CROSS_DOC_COREF r_id="5" note="ACT1"><source m_id="7" /><target m_id="9" /></CROSS_DOC_COREF></Relations></Document>"""
    got = rows(readers.read("ecb_plus", spark, write(tmp_path, "1_1.xml", text)), "mention", "kind", "tokens", "text", "chain")
    assert got == [("7", "ACTION_OCCURRENCE", [2], "hits", "ACT1"), ("8", "NON_HUMAN_PART", [1, 3], "Quake town", None)]


def test_maven_arguments(spark, tmp_path):
    doc = {"id": "d", "document": "x", "events": [{"type": "Attack", "argument": {"Agent": [{"content": "army"}, {"entity_id": "E1"}], "Target": []}}]}
    assert rows(readers.read("maven_arg", spark, write(tmp_path, "a.jsonl", json.dumps(doc))), "id", "k", "role", "content") == sorted([("d", 0, "Agent", None), ("d", 0, "Agent", "army")], key=str)


TOKENS = {
    "tsv_ner": ("Ann\tB-PER\nran\tO\n\nBob\tB-PER\n", [(1, "Ann", "B-PER"), (1, "Bob", "B-PER"), (2, "ran", "O")]),
    "csv_ner": ("1,Ann,NNP,B-PER\n,ran,VB,O\n", [(1, "Ann", "B-PER"), (2, "ran", "O")]),
    "conllu": ("# text = a b\n1\ta\ta\tNOUN\n1-2\tab\t_\t_\n2\tb\tb\tVERB\n", [(1, "a", "NOUN"), (2, "b", "VERB")]),
    "bc5cdr": ("drug\tNN\tB-Chemical\n", [(1, "drug", "B-Chemical")]),
    "ncbi_disease": ("flu B-Disease\n", [(1, "flu", "B-Disease")]),
    "litbank": ("Emma\tB-PER\tO\n", [(1, "Emma", "B-PER")]),
    "conll": ("-DOCSTART- -X- O O\n\nEU NNP B-NP B-ORG\n", [(1, "EU", "B-ORG")]),
}


@pytest.mark.parametrize("kind", TOKENS)
def test_token_columns(spark, tmp_path, kind):
    text, want = TOKENS[kind]
    assert rows(readers.read(kind, spark, write(tmp_path, "f.txt", text)), "position", "token", "tag") == want


LINES = {
    "tweetner7": ({"tokens": ["a", "b"], "tags": ["O", "B"]}, ("token", "tag"), [("a", "O"), ("b", "B")]),
    "cadec_jsonl": ({"text": "ouch", "entities": [{"start": 0, "end": 4, "label": "ADR"}]}, ("text", "start", "end", "label"), [("ouch", 0, 4, "ADR")]),
    "docred": ({"sentence": ["a"], "ner": [{"start": 0, "end": 1, "type": "ORG"}]}, ("start", "end", "type"), [(0, 1, "ORG")]),
    "docred_relations": ({"relations": [{"head": 0, "tail": 1, "type": "P17"}]}, ("head", "tail", "type"), [(0, 1, "P17")]),
    "google_re": ({"sub": "/m/1", "obj": "/m/2", "pred": "born", "evidences": [{"url": "u", "snippet": "s"}]}, ("sub", "snippet"), [("/m/1", "s")]),
    "maven": ({"id": "d", "events": [{"type": "T", "mention": [{"trigger_word": "w", "sent_id": 0}]}]}, ("id", "type"), [("d", "T")]),
    "casie": ({"id": "d", "content": "c", "event": [{"type": "Attack", "subtype": "Phishing"}]}, ("id", "type", "subtype"), [("d", "Attack", "Phishing")]),
    "rams": ({"doc_key": "k", "sentences": [["a"]], "evt_triggers": [], "gold_evt_links": []}, ("doc_key",), [("k",)]),
    "preco": ({"id": "p", "sentences": [["a"]], "mention_clusters": [[[0, 0, 1]]]}, ("id", "mention_clusters"), [("p", [[[0, 0, 1]]])]),
    "afriqa": ({"id": "q", "question": "w?", "context": "c", "answers": {"text": ["a"], "answer_start": [0]}}, ("id", "question"), [("q", "w?")]),
    "agnews": ({"text": "t", "label": 3}, ("text", "label"), [("t", 3)]),
    "dbpedia14": ({"title": "t", "content": "c", "label": 1}, ("title", "label"), [("t", 1)]),
    "yahoo_answers": ({"question_title": "q", "question_content": "", "best_answer": "a", "topic": 4}, ("question_title", "topic"), [("q", 4)]),
    "tweettopic": ({"text": "t", "label": 2, "label_name": "sports"}, ("text", "label_name"), [("t", "sports")]),
    "chisiec": ({"entities": [{"type": "PER", "start": 0, "end": 2}]}, ("type", "start", "end"), [("PER", 0, 2)]),
    "chisiec_relations": ({"relations": [{"type": "r", "head": 0, "tail": 1}]}, ("type", "head", "tail"), [("r", 0, 1)]),
    "cadec_rows": ({"rows": [{"row": {"text": "t", "ade": "a", "term_PT": "p"}}]}, ("text", "ade"), [("t", "a")]),
    "json_ld": ({"@graph": [{"@id": "i", "@type": "T"}]}, (), []),
}


@pytest.mark.parametrize("kind", LINES)
def test_json_formats(spark, tmp_path, kind):
    document, columns, want = LINES[kind]
    got = readers.read(kind, spark, write(tmp_path, "f.json", json.dumps(document)))
    assert rows(got, *columns) == want if columns else got.count() == 1


@pytest.mark.parametrize("kind, text, want", [("afrisenti", "tweet\tlabel\nhello\tpositive\n", 1), ("masakhanews", "category\ttext\nsports\tthe text\n", 1), ("trec", "DESC:manner How did it go ?\n", 1), ("gap", "ID\tText\tPronoun\tPronoun-offset\tA\tA-offset\tA-coref\tB\tB-offset\tB-coref\tURL\nt-1\tAnn and Eve, she\tshe\t13\tAnn\t0\tTRUE\tEve\t8\tFALSE\tu\n", 1)])
def test_tables(spark, tmp_path, kind, text, want):
    assert readers.read(kind, spark, write(tmp_path, "f.tsv", text)).count() >= want
