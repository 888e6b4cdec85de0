"""The index made as texts are read: the rows and answers of a stored one, and little disk."""

import os

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import projection
from quillgrid.operators.document_index import DocumentIndex, TextIndex, T, key_of, plain, term_arrays
from quillgrid.operators.query import LEXICON
from quillgrid.plans import catalogue
from quillgrid.schema import table

SCHEMA = "id string, title string, abstract string, keywords array<string>, year int"


def docs(spark):
    rows = [(f"d{k}", f"Title {k} of graphs", f"Sentence {k} one. " * (k % 40), [f"word{k}", "shared"], 2000 + k % 25) for k in range(30)]
    odd = [(None, "no id", "x", None, None), ("empty", None, None, None, None), ("twice", "one", "a", None, None), ("twice", "two", "b", None, None), ("same", "🙂 ключ", "漢字 한국어 " * 90, [], None), ("run", "aaaa aaaa", "aaaa aaaa aaaa", [], 2001)]
    return spark.createDataFrame(rows + odd, SCHEMA)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    stored = DocumentIndex(spark, f"file://{tmp_path_factory.mktemp('stored')}/index", T.StringType(), dims=64, parts=2)
    stored.refresh(docs(spark))
    return stored, TextIndex(docs(spark), dims=64)


def test_rows_are_those_that_a_stored_index_holds(both):
    stored, passing = both
    plain = lambda df: sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in sorted(df.columns) if c != "fingerprint")) for r in df.collect()), key=repr)
    assert plain(passing.documents()) == plain(stored.documents())
    assert plain(passing.passages()) == plain(stored.passages())
    some = passing.documents("body_total", "year")
    assert some.columns == ["id", "year", "body_total"] and plain(some) == plain(stored.documents().select("id", "year", "body_total"))


def test_answers_are_those_of_a_stored_index(both, spark):
    stored, passing = both
    questions = [("sentence one of graphs", ["sentence", "graphs", "none"]), ("한국어 aaaa", ["aaaa"]), ("", [])]
    passing.ask(questions)
    for text, terms in questions:
        want, got = ({r.id: r for r in x.parts_of(text, terms).collect()} for x in (stored, passing))
        assert set(want) == set(got)
        for i, w in want.items():
            assert tuple(got[i][1:]) == pytest.approx(tuple(w[1:]), abs=1e-12)
    head = spark.createDataFrame([("d7",), ("same",)], "id string")
    plain = lambda x: {r.id: (round(r.passage, 9), r.label) for r in x.best_passages(head, "title 7").collect()}
    assert plain(stored) == plain(passing)


def test_a_search_keeps_less_than_the_texts(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared) for f in files)
    before, texts = size(), table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    catalogue.queries()["bm25_topk"](spark, sf_dir).collect()
    catalogue.queries()["document_index"](spark, sf_dir).count()
    assert size() - before < texts


@pytest.mark.parametrize("lexicon", [None, LEXICON])
def test_terms_of_questions_are_counted_as_in_all_terms_of_a_text(lexicon):
    expand = lexicon.expand_normal if lexicon else None
    texts = ["", "ab", "aaaa aaaa aaaa", "the tion and the tion and the", "漢字 한국어 한국어 x " * 9, "graph neural network graph", "one two three two three four two three", "🙂 a b cd"]
    texts = [plain(t) for t in (*texts, *(" ".join(g) for g in (lexicon.groups if lexicon else ())))]
    for question in texts:
        asked = projection.Asked(question, ["the", "aaaa", "two", "none", "x"], expand)
        keys, weights = term_arrays(question, expand)
        for text in texts:
            every = dict(zip(*(x.tolist() for x in term_arrays(text, expand)), strict=True))
            tokens = projection.words(text)
            held = projection.Held(text, tokens, expand if expand and projection.touched(tokens, expand) else None)
            assert held.total == sum(every.values())
            assert held.least(asked) == sum(min(w, every.get(k, 0)) for k, w in zip(keys.tolist(), weights.tolist(), strict=True))
            assert [held.weight(t) for t in asked.wanted] == [every.get(key_of(t), 0) for t in asked.wanted]


def test_edges_of_results_make_no_vectors(spark, sf_dir, monkeypatch):
    asked = []
    ask = TextIndex.ask
    monkeypatch.setattr(TextIndex, "ask", lambda self, questions, dense=True: asked.append(dense) or ask(self, questions, dense))
    assert catalogue.queries()["result_edges"](spark, sf_dir).count() and asked == [False]
