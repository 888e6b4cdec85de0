"""Stored rows and facts, merges in order, pages, neighbourhoods and expansions: plain versions and odd rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators import dedupe, detail, features, graph, stored

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def test_json_rows(spark, tmp_path):
    data = [("a", 1, ["x\ny", 'q"']), ("b", None, None), ("c", 3, []), (None, 4, None), ("a", 1, ["x\ny", 'q"']), ("é 漢", 5, [" "])]
    rows = stored.JsonRows(spark, f"file://{tmp_path}/rows", ROW, parts=4)
    rows.replace(spark.createDataFrame([(*r, "more") for r in data], "id string, n long, tags array<string>, value string"))
    want = sorted([("a", 1, ["x\ny", 'q"']), ("b", None, None), ("c", 3, []), ("é 漢", 5, [" "])])
    assert sorted(tuple(r) for r in rows.scan().collect()) == want
    one = rows.lookup("c")
    assert [tuple(r) for r in one.collect()] == [("c", 3, [])] and rows.lookup("z").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PartitionFilters: []" not in plan
    asked = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "id string")
    assert [tuple(r) for r in rows.lookups(asked).collect()] == [("b", None, None)]
    rows.replace(spark.createDataFrame([("only", 1, None)], ROW))
    assert [r.id for r in rows.scan().collect()] == ["only"]


def test_facts_delete_rewrites_only_what_it_touches(spark, tmp_path):
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
    facts = stored.Facts(spark, f"file://{tmp_path}/facts", schema, "kind")
    assert facts.rows().count() == 0 and facts.delete(F.col("n") > 0) == 0
    data = [("a", k) for k in range(5)] + [("b/ =c", k) for k in range(5)] + [(None, 1), (None, 2), ("a", 1), ("d", None)]
    facts.append(spark.createDataFrame(data, schema))
    facts.append(spark.createDataFrame([("a", 9)], schema))
    files = lambda: {r.f for r in facts.rows().select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    assert facts.delete((F.col("kind") == "a") & (F.col("n") > 2)) == 3
    assert {f for f in before if "kind=a/" not in f} < files() and not {f for f in before if "kind=a/" in f} & files()
    assert facts.delete(F.col("kind") == "b/ =c") == 5 and facts.delete(F.col("kind").isNull() & (F.col("n") == 1)) == 1
    assert facts.delete(F.col("n") > 100) == 0
    assert sorted(((r.kind, r.n) for r in facts.rows().collect()), key=repr) == sorted([("a", 0), ("a", 1), ("a", 1), ("a", 2), (None, 2), ("d", None)], key=repr)


def test_merge_is_in_order(spark):
    schema = "id long, key string, title string, source string, citations int, abstract string, summary string, organization string, englishTitle string, openAccess boolean, keywords array<string>, links map<string,string>, sourceIds map<string,string>"
    row = lambda i, **v: (i, v.get("key", "k"), f"t{i}", v.get("source", f"s{i}"), v.get("cited"), v.get("abstract"), v.get("summary"), v.get("org"), v.get("en"), v.get("open"), v.get("kw"), v.get("links"), v.get("ids"))
    first = spark.createDataFrame([row(9, abstract="ab", kw=["b", "a"], links={"x": "1"}, org="", cited=1, open=False)], schema)
    second = spark.createDataFrame([row(1, abstract="cd", summary="long", kw=["a", "c"], links={"x": "2", "y": "3"}, org="house", cited=7, open=True, ids={"doi": "d"}), row(2, kw=[f"w{k}" for k in range(30)], en="E"), row(3, key=None)], schema)
    got = {r.key: r for r in dedupe.canonical_merge(stored.ordered_union([first, second]), "key", ("ord", "id")).collect()}
    k = got["k"]
    assert (k.id, k.title, k.source, k.records, k.citations, k.abstract, k.summary, k.organization, k.englishTitle, k.openAccess) == (9, "t9", "s9", 3, 7, "ab", "long", "house", "E", True)
    assert k["keywords"] == ["b", "a", "c", *(f"w{n}" for n in range(9))] and k.links == {"x": "2", "y": "3"} and k.sourceIds == {"doi": "d"} and k.sources == ["s1", "s2", "s9"]
    assert (got[None].id, got[None]["keywords"], got[None].links) == (3, [], {})


@pytest.mark.parametrize("hot", [False, True])
def test_heuristic_neighbourhood_is_that_of_all_pairs(spark, hot):
    r = random.Random(4)
    rows = [(i, " ".join(r.sample(["alpha", "beta", "gamma", "delta", "eps", "zeta"], r.randint(0, 2)) + ["common"] * hot), r.choice([None, ["kw"], ["Beta x"], []]), r.choice([None, 2001, 2002, 2005, 2009]), r.choice([None, 0, 3, 3, 9, 40])) for i in range(90)]
    docs = spark.createDataFrame(rows, "id long, title string, keywords array<string>, year int, citations int")
    words = {i: {w.lower() for w in " ".join([t, *(k or [])]).split() if len(w) > 1} for i, t, k, *_ in rows}
    want = set()
    for i, _, _, year, _ in rows:
        near = [(-(c or 0), j, y or 0) for j, _, _, y, c in rows if j != i and words[i] & words[j]]
        for side, kept in (("references", [n for n in near if n[2] <= (year or 2**31)]), ("citations", [n for n in near if n[2] >= (year or 0)])):
            want |= {(i, side, k + 1, j) for k, (_, j, _) in enumerate(sorted(kept)[:3])}
    assert {(x.p_id, x.side, x["rank"], x.id) for x in graph.heuristic_neighbourhood(docs, docs, 3).collect()} == want


def test_pages_take_stored_lists_first(spark):
    docs = spark.createDataFrame([(1, 100, 2024), (2, None, None), (3, 0, 2000)], "id long, citations int, year int")
    kept = spark.createDataFrame([(1, 3, "references", 0.5), (1, 2, "references", 0.9), (1, 2, "references", 0.1), (2, 1, "similar", 0.9)], "source_id long, target_id long, edge_type string, weight double")
    other = spark.createDataFrame([(1, "references", 1, 7), (1, "citations", 1, 3), (1, "citations", 2, 2)], "p_id long, side string, rank int, id long")
    got = {r.id: r for r in detail.pages(docs, detail.lists_of(kept, other)).collect()}
    assert (got[1].references, got[1].citations, got[1].references_stored, got[1].citations_stored, got[1].related, got[1].impact, got[1].fresh) == ([2, 3], [3, 2], True, False, [3, 2], 61, True)
    assert (got[2].references, got[2].related, got[2].impact, got[2].fresh) == ([], [], 0, False)


def test_expansion_is_containment(spark):
    r = random.Random(8)
    letters = "abcd"
    words = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 2))) for _ in range(120)] + ["지식", "지식 그래프", "식", "abcdabcdabcd", ""]
    keys = [(k, r.random() < 0.2, [k, f"{k}-group"]) for k in r.sample(words, 60)] + [("지식", False, ["지식", "knowledge"]), ("abcdabcdabcdabcd", False, ["long"])]
    lexicon = spark.createDataFrame([(k, b, g) for k, b, g in keys], "key string, blocked boolean, words array<string>")
    terms = r.sample(words, 90) + ["지식 그래프", "abcdabcdabcd", None, "abcdabcdabcd"]
    wide = lambda t, n: " " in t or (any("가" <= c <= "힣" for c in t) and len(t) >= 2) or len(t) >= n
    blocked = {k for k, b, _ in keys if b}
    want = set()
    for t in filter(None, terms):
        want.add((t, t))
        for k, _, group in keys:
            if k and (k == t or (k in t and k not in blocked and wide(k, 4)) or (t in k and t not in blocked and wide(t, 10))):
                want |= {(t, g) for g in group}
    got = features.expand_terms(spark.createDataFrame([(t,) for t in terms], "term string"), lexicon)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
