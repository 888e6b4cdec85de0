"""Refreshes of the stored index at size: what is shuffled, how rows are packed, and hashes of long texts."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import types as T

from quillgrid.functions import projection
from quillgrid.operators import document_index
from quillgrid.operators.document_index import DocumentIndex

SCHEMA = "id long, title string, abstract string, year int"


def docs(spark, ids, year=2000):
    return spark.createDataFrame([(k, f"Title {k}", f"Sentence {k} of graphs. " * (k % 9), year + k % 3) for k in ids], SCHEMA)


def test_the_index_itself_is_not_shuffled(spark, tmp_path, monkeypatch):
    """texts are dealt before they are hashed; rows that stay are written where they are read."""
    plans, write = [], DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    index = DocumentIndex(spark, f"file://{tmp_path}/index", dims=64, parts=4)
    assert index.refresh(docs(spark, range(40))).added == 40
    assert index.refresh(docs(spark, range(5, 50), 2010)).changed == 35
    assert index.refresh(docs(spark, range(7, 50), 2010)).removed == 2
    assert len(plans) == 3
    for plan in plans[:2]:
        assert 0 <= plan.index("MapInPandas") < plan.index("Exchange")
    for plan in plans[2:]:
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_refreshes_in_steps_are_one_refresh(spark, tmp_path, monkeypatch, few):
    """Whether ids are broadcast or joined, and in however many slots a part is dealt."""
    monkeypatch.setattr(document_index, "BROADCAST", few)
    monkeypatch.setattr(document_index, "LEAST_CHARS", 10)
    plain = lambda index: sorted(str([list(v) if isinstance(v, (list, tuple)) else v for n, v in r.asDict().items() if n != "version"]) for r in index.rows().collect())
    steps, once = (DocumentIndex(spark, f"file://{tmp_path}/{n}", dims=64, parts=4) for n in ("steps", "once"))
    last = docs(spark, range(6, 60)).unionByName(docs(spark, [8, 61, 61], 1990))
    for x in (docs(spark, range(50)), docs(spark, range(3, 55), 2005), last):
        steps.refresh(x)
    assert once.refresh(last).added == 55 and plain(steps) == plain(once) and steps.documents().count() == 55


def test_rows_are_packed_and_come_back(spark, tmp_path):
    r = np.random.default_rng(2)
    for have, body in ((0, 0), (0, 5), (9, 0), (50, 30)):
        keys, more = np.unique(r.integers(-(2**63), 2**63 - 1, have)), np.unique(r.integers(-(2**63), 2**63 - 1, body))
        more = np.unique(np.concatenate([more, keys[::3]]))
        weights = r.integers(1, 1000, len(more)).astype(np.int32)
        row = document_index.packed_row({"id": 1, "keys": keys, "body_keys": more, "body_weights": weights})
        got = document_index._unpacked_body(row["keys"], row["body_keys"], row["body_weights"])
        assert np.array_equal(got[0], more) and np.array_equal(got[1], weights) and np.array_equal(document_index.unpacked(row["keys"], np.int64), keys)
    index = DocumentIndex(spark, f"file://{tmp_path}/index", dims=64, parts=2)
    index.refresh(docs(spark, range(12)))
    assert isinstance(spark.read.parquet(index.path).schema["keys"].dataType, T.BinaryType)
    made = document_index.TextIndex(docs(spark, range(12)), 64)
    names = ["id", "vector", "keys", "weights", "total", "body_vector", "body_keys", "body_weights", "body_total", "words", "methods", "title", "year", "fingerprint"]
    assert sorted(map(str, index.documents().select(names).collect())) == sorted(map(str, made.documents(*names[1:]).select(names).collect()))


@pytest.mark.parametrize("few", [1, 4, 10_000])
def test_windows_are_hashed_as_one_by_one(monkeypatch, few):
    monkeypatch.setattr(projection, "FEW", few)
    r = np.random.default_rng(7)
    codes = np.concatenate([r.integers(0, 128, 300), r.integers(0, 256, 300), r.integers(0, 65536, 300)]).astype(np.uint32)
    start = r.integers(0, 800, 60)
    length = np.where(r.random(60) < 0.2, 0, r.integers(0, 100, 60))
    before = [r.integers(0, 2**32, 60).astype(np.uint32) for _ in range(2)]
    for h, got in zip(before, projection._windows(codes, start, length, before), strict=True):
        assert got.tolist() == [projection._hash(codes[s : s + n].tolist(), int(b)) for s, n, b in zip(start, length, h, strict=True)]


def test_terms_of_many_texts_are_those_of_each():
    from quillgrid.operators.query import LEXICON

    texts = ["", "a", "one", "one two", "one two three one two", "battery cell and battery", "das wetter ändert sich œuvre", "기후 변화 연구", "🙂🙂 x yy", "one " * 700 + "two"]
    for expand in (None, LEXICON.expand_normal):
        for text, (keys, weights) in zip(texts, document_index.terms_of(texts, expand), strict=True):
            want = projection.word_terms(text, expand)
            grams = dict(zip(*(x.tolist() for x in projection.gram_keys(text))))
            assert dict(zip(keys.tolist(), weights.tolist())) == grams | dict(zip(document_index.keys_of(want).tolist(), want.values())) and sorted(keys.tolist()) == keys.tolist()
        many = projection.dense_vectors(texts, 64, expand)
        assert all(np.array_equal(many[k], projection.dense_vector(t, 64, expand)) for k, t in enumerate(texts))
