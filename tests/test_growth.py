"""What keeps queries from growing faster than their tables: work done once a text, and rows that stay where they are."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as tx
from quillgrid.llm.bpe import WordTokenizer, default_path
from quillgrid.operators import features, passages, recommend
from quillgrid.plans import catalogue


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_token_counts_are_those_of_the_ids():
    tok = WordTokenizer(default_path())
    texts = ["", "Plain words, twice words", "  a\n<|endoftext|>b ", "déjà 世界 x" * 30, "<| no special |>"]
    assert [tok.count_of(t) for t in texts] == [len(tok.ids_of(t).split()) for t in texts]
    assert tok.run_sizes  # runs are counted once


def test_texts_are_made_normal_once_for_all_queries(spark, sf_dir):
    assert _plan(catalogue.queries()["query_match"](spark, sf_dir), "optimizedPlan").count("regexp_replace") <= 2


def test_corpus_stats_keep_nothing_by_document_and_term(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None), (1, "two three"), (None, "four x")], "id long, text string")
    assert features.text_stats(docs).collect() == features.corpus_stats(features.term_table(docs)).collect()
    assert features.text_stats(docs.limit(0)).collect() == features.corpus_stats(features.term_table(docs.limit(0))).collect()


def test_terms_of_a_document_stay_together(spark, sf_dir):
    """The texts are dealt by id, once for the pairs and once for the totals; nothing is dealt by (id, term) or (a, b)."""
    plan = _plan(catalogue.queries()["sparse_overlap"](spark, sf_dir))
    assert "hashpartitioning(b" not in plan and "hashpartitioning(a" not in plan and "hashpartitioning(id" not in plan.replace("hashpartitioning(item", "")[: plan.find("BroadcastExchange")]


def test_texts_without_a_heading_of_references_are_not_made_normal(monkeypatch):
    entry = "\n[1] Kim, A., Park, B. 2021. Learning to rank sparse signals well. Journal A."
    listed = [head + entry for head in ("Body.\nReferences", "Body.\nＲＥＦＥＲＥＮＣＥＳ", "see Bıbliography", "참고문헌", "the reſult\nReferenceſ")]
    assert all(len(passages.extract_references(t)) == 1 for t in listed)

    def never(text):
        raise AssertionError(text)

    monkeypatch.setattr(passages, "normalize", never)
    assert passages.extract_references("A body\nof lines\nwithout" + entry) == []


@pytest.mark.parametrize("size", [1, 64])
def test_sections_come_by_few_texts(spark, monkeypatch, size):
    monkeypatch.setattr(passages, "TEXTS", size)
    docs = spark.createDataFrame([(1, "Abstract\none, 1\nMethod\ntwo, 2"), (2, None), (3, "x, 3\n\ny, 4")], "id long, abstract string")
    assert [tuple(r) for r in passages.sections(docs).orderBy("id", "ord").collect()] == [(1, 1, "abstract", "abstract", "one, 1"), (1, 2, "method", "method", "two, 2"), (3, 1, "body", "body", "x, 3 y, 4")]


def test_full_recommendations_make_no_row_of_every_pair(spark):
    docs = spark.range(300).select("id", F.lit("a common title").alias("title"), F.array(F.lit("common")).alias("keywords"), F.array(F.lit("ann")).alias("authors"), F.array(F.lit("m")).alias("methods"), F.lit("house").alias("organization"), F.lit("src1").alias("source"), F.lit("domestic").alias("region"), F.lit(2020).alias("year"))
    edges = spark.createDataFrame([], "source_id string, target_id string, edge_type string, weight double")
    out = recommend.full(docs, docs, edges, 2)
    assert "key#" not in _plan(out, "optimizedPlan")  # no join on what documents share
    assert {(r.p_id, r.id) for r in out.collect()} == {(i, j) for i in range(300) for j in [k for k in range(3) if k != i][:2]}


def test_char_ngrams_come_without_work_by_element(spark, sf_dir):
    texts = [None, "", " ", "ab", "abc", "Ab c-d", "가나 다", "가", "déjà 𝒳y z", "x" * 3_000, "日本 語 text 12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.char_ngrams(F.col("text")).alias("g"), tx.compact_text(F.col("text")).alias("c"), tx.char_ngrams_digest(tx.compact_text(F.col("text"))).alias("d")).collect()
    for r in rows:
        sizes = (2, 3, 4) if "가" in r.c else (3, 4, 5)
        want = [r.c[k : k + size] for size in sizes for k in range(len(r.c) - size + 1)]
        assert (r.g, r.d.n, r.d.grams_md5) == (want, len(want), hashlib.md5("|".join(want).encode()).hexdigest())
    assert "zip_with" not in _plan(catalogue.queries()["char_ngrams"](spark, sf_dir), "optimizedPlan")
