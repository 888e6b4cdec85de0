"""The stored index: refreshes that touch only what changed, odd rows, and searches over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import projection
from quillgrid.operators import document_index, search
from quillgrid.operators.document_index import DocumentIndex, Refreshed, plain
from quillgrid.operators.query import Lexicon, normalize

SCHEMA = "id string, title string, abstract string, summary string, keywords array<string>, organization string, year int, updatedAt string, version string, part string"


@pytest.fixture
def index(spark, tmp_path):
    return DocumentIndex(spark, f"file://{tmp_path}/index", document_index.T.StringType(), dims=64, parts=4)


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r)), "clash", "clash") for r in rows], SCHEMA)


def rows(n):
    return [(f"d{k}", f"Title {k} of graphs", f"Sentence {k} one. " * (k % 40), "A summary", [f"word{k}", "shared"], "institute", 2000 + k % 25, "2024-01-01") for k in range(n)]


def files(index):
    return {r.f: r.t for r in index.rows().select(F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}


def contents(index):
    return sorted((r.id, r.ord, r.label, r.passage, r.fingerprint, list(r.vector), r["keys"] and list(r["keys"]), r.total, r.body_vector and list(r.body_vector)) for r in index.rows().collect())


def test_refresh_touches_what_changed(spark, index, tmp_path):
    start = rows(60)
    assert index.refresh(docs(spark, start)) == Refreshed(60, 0, 0, 0, 4, 60)
    before = files(index)
    assert index.refresh(docs(spark, start)) == Refreshed(0, 0, 0, 60, 0, 0) and files(index) == before
    start[7] = ("d7", "Another title", *start[7][2:])
    got = index.refresh(docs(spark, start))
    assert (got.added, got.changed, got.removed, got.same, got.parts) == (0, 1, 0, 59, 1) and got.rewritten < 40
    part = index.documents().where("id = 'd7'").count() and index.rows().where("id = 'd7'").select("part").first()[0]
    assert {f for f in before if f"/part={part}/" not in f} == {f for f in files(index) if f in before}
    start[3] = (*start[3][:7], "2024-02-02")  # a newer date alone
    start = start[:50] + [("new", "New", "text. " * 90, None, None, None, None, None)]
    got = index.refresh(docs(spark, start))
    assert (got.added, got.changed, got.removed, got.same) == (1, 1, 10, 49)
    again = DocumentIndex(spark, f"file://{tmp_path}/again", document_index.T.StringType(), dims=64, parts=4)
    again.refresh(docs(spark, start))
    assert contents(index) == contents(again)


def test_only_changed_documents_are_hashed(spark, index, monkeypatch):
    index.refresh(docs(spark, rows(20)))
    real = document_index._Hasher

    class Told:
        def __init__(self, *made):
            self.hasher = real(*made)

        def __call__(self, batches):
            for batch in batches:
                assert list(batch["id"]) == ["d20"]
                yield from self.hasher(iter([batch]))

    monkeypatch.setattr(document_index, "_Hasher", Told)
    assert index.refresh(docs(spark, rows(20))).same == 20
    assert index.refresh(docs(spark, rows(21))).added == 1 and index.documents().count() == 21


def test_odd_rows(spark, index):
    odd = [(None, "no id", "x"), ("empty", None, None), ("blank", " \n", "?! "), ("twice", "one", "a"), ("twice", "two", "b"), ("long", "Long", " ".join(f"w{k}" for k in range(40_000))), ("same", "All", "All"), ("same2", "🙂 ключ", "漢字 " * 200)]
    assert index.refresh(docs(spark, odd)).added == 6
    got = {r.id: r for r in index.documents().collect()}
    assert set(got) == {"empty", "blank", "twice", "long", "same", "same2"}
    assert not any(got["empty"].vector) and got["empty"].total == 0 and got["blank"].total == 0
    passages = {}
    for r in index.passages().collect():
        passages.setdefault(r.id, []).append((r.ord, r.label, r.passage))
    assert "empty" not in passages and len(passages["long"]) > 500 and [p[1:] for p in sorted(passages["same"])] == [("title", "All"), ("abstract", "All")]
    assert sorted(o for o, *_ in passages["long"]) == list(range(1, len(passages["long"]) + 1))
    assert index.refresh(docs(spark, odd)).same == 6
    assert index.refresh(docs(spark, [])).removed == 6 and index.rows().count() == 0
    assert index.refresh(docs(spark, [])) == Refreshed(0, 0, 0, 0, 0, 0)


def test_parts_of_a_query_are_the_plain_ones(spark, index):
    data = rows(40)
    index.refresh(docs(spark, data))
    text, terms = "sentence one of graphs", ["sentence", "graphs", "none"]
    got = {r.id: r for r in document_index.query_parts(index.documents(), text, terms, 64).collect()}
    q, qs = projection.dense_vector(text, 64), projection.sparse_terms(text)
    bundles = {d[0]: plain(" ".join([d[1], d[1], d[2], d[2], d[3], d[5], " ".join(d[4]), " ".join(d[4])])) for d in data}
    sparse = {i: projection.sparse_terms(b) for i, b in bundles.items()}
    mean = np.mean([s.total() / 20 for s in sparse.values()])
    for i, b in bundles.items():
        v = projection.dense_vector(b, 64)
        assert got[i].dense == pytest.approx(v @ q / np.linalg.norm(v) / np.linalg.norm(q), abs=1e-6)
        least = sum(min(w, sparse[i][t]) for t, w in qs.items())
        assert got[i].sparse == pytest.approx(least / (qs.total() + sparse[i].total() - least))
        bm = 0
        for t in terms:
            df, tf = sum(t in s for s in sparse.values()), sparse[i][t] / 20
            bm += np.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sparse[i].total() / 20 / mean))
        assert got[i].bm25 == pytest.approx(bm)


def test_search_over_an_index(spark, index):
    data = docs(spark, rows(40)).withColumns({"type": F.lit("paper"), "source": F.lit("src1"), "region": F.lit("global"), "language": F.lit("en"), "citations": F.lit(3)})
    with_index = search.search(search.Index.of(data, index), "title 7 of graphs", k=40).collect()
    without = search.search(search.Index.of(data), "title 7 of graphs", k=40).collect()
    assert with_index[0].id == without[0].id == "d7" and {r.id for r in with_index} == {r.id for r in without}
    assert with_index[0].match > without[0].match and with_index[0].total > without[0].total


def nested(groups, blocked, values):
    """Lexicon.expand by comparing every value with every term."""
    group_of = {t: g for g in groups for t in g}
    wide = lambda t, n: t not in blocked and (" " in t or (any("가" <= c <= "힣" for c in t) and len(t) >= 2) or len(t) >= n)
    out = []
    for v in filter(None, map(normalize, values)):
        out.append(v)
        for t, g in group_of.items():
            if t == v or (t in v and wide(t, 4)) or (v in t and wide(v, 10)):
                out += g
    return list(dict.fromkeys(out))


GROUPS = [["battery", "배터리", "secondary battery"], ["cell", "cells"], ["graph memory", "지식 그래프"], ["semiconductors", "반도체"], ["ab", "abcd"]]


def test_expansion_by_automaton_is_the_nested_loop(spark):
    values = ["battery", "batteryless cell", "배터리", "리튬배터리팩", "graph", "graph memory", "a graph memory of cells", "semiconductor", "semicond", "abcde", "ab", "", " ?!", "그래프", "지식 그래프 x", "secondary battery pack"]
    for blocked in ((), ("cell", "cells", "abcd", "graph memory")):
        lexicon = Lexicon(GROUPS, blocked)
        for v in values:
            assert lexicon.expand([v]) == nested(GROUPS, blocked, [v]), v
        assert lexicon.expand(values) == nested(GROUPS, blocked, values)
    table = spark.createDataFrame([(k, t, t == "cell") for k, g in enumerate(GROUPS) for t in g], "group int, term string, blocked boolean")
    made = Lexicon.of(table)
    assert made.blocked == {"cell"} and [sorted(g) for g in made.groups] == [sorted(g) for g in GROUPS] and made.digest != Lexicon(GROUPS).digest
    assert Lexicon([]).expand(["any thing"]) == ["any thing"]


def test_a_lexicon_adds_to_vectors_and_terms(spark, tmp_path):
    lexicon = Lexicon(GROUPS)
    text = "batteries and a battery cell"
    added = projection.sparse_terms(text, lexicon.expand) - projection.sparse_terms(text)
    assert added == {"배터리": 17, "secondary battery": 25, "cells": 17}
    assert not np.array_equal(projection.dense_vector(text, 64), projection.dense_vector(text, 64, lexicon.expand))
    assert np.array_equal(projection.dense_vector("nothing here", 64), projection.dense_vector("nothing here", 64, lexicon.expand))
    data = docs(spark, [("ko", "배터리", "배터리 연구"), ("en", "battery", "battery study"), ("no", "other", "words only")])
    index = DocumentIndex(spark, f"file://{tmp_path}/with", document_index.T.StringType(), dims=256, parts=2, lexicon=lexicon)
    index.refresh(data)
    got = {r.id: r for r in document_index.query_parts(index.documents(), "배터리", ["배터리"], 256, lexicon).collect()}
    assert got["en"].sparse > 0 and got["en"].bm25 > 0 and got["en"].dense > got["no"].dense
    other = DocumentIndex(spark, index.path, document_index.T.StringType(), dims=256, parts=2, lexicon=None)
    assert other.refresh(data).changed == 3  # another lexicon changes every document
    bare = {r.id: r for r in document_index.query_parts(other.documents(), "배터리", ["배터리"], 256, None).collect()}
    assert bare["en"].bm25 == 0


def test_best_pairs_over_blocks_are_those_of_all_pairs(spark):
    import math

    from quillgrid.operators import vector_search

    r = np.random.default_rng(3)
    rows = [(i, None if i % 17 == 0 else [0.0] * 5 if i % 13 == 0 else r.normal(size=5).round(1).tolist(), None if i % 7 == 0 else [["a", "B", "b", "c", "hot"][k] for k in r.integers(0, 5, 3)] + ["hot"], None if i % 11 == 0 else int(i % 4)) for i in range(80)]
    rows += [(200, rows[1][1], rows[1][2], 1), (201, rows[1][1], rows[1][2], 1), (None, rows[1][1], ["a"], 2)]
    data = spark.createDataFrame(rows, "id long, vector array<double>, tags array<string>, year int")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)
    want = set()
    for i, v, tags, year in rows:
        if i is None or v is None:
            continue
        found = []
        for j, w, others, late in rows:
            if j is None or w is None or i == j or year is None or late is None or late > year:
                continue
            a, b = {t.lower() for t in tags or []}, {t.lower() for t in others or []}
            score = round(0.7 * cosine(v, w) + 0.3 * (len(a & b) / max(len(a), len(b)) if a and b else 0), 6)
            if score >= 0.2:
                found.append((-score, j))
        want |= {(i, j, -s) for s, j in sorted(found)[:3]}
    rate = lambda a, b: np.where(b.values["year"][None] <= a.values["year"][:, None], 0.7 * a.cosine(b) + 0.3 * a.overlap(b, "tags"), -np.inf)
    for size in (7, 500):
        got = vector_search.best_pairs(data, data, 3, rate, least=0.2, sets=("tags",), values=("year",), rows=size)
        assert {(x.source_id, x.target_id, round(x.score, 6)) for x in got.collect()} == want
    assert vector_search.best_pairs(data.limit(0), data.limit(0), 3, rate, sets=("tags",), values=("year",)).count() == 0
