"""Every registered query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quillgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else float(v) if type(v).__name__ == "Decimal" else str(v).replace("+00:00", "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rel = duck.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_no_query_plans_a_cartesian_product(spark, sf_dir):
    for name in ("similar_titles", "reference_edges", "topic_edges", "two_hop_paths", "library_view", "sparse_overlap", "knn_edges", "similar_edges", "semantic_edges", "citation_neighbourhood", "detail_pages", "lexicon_expansion", "canonical_merge", "ordered_merge", "stored_documents"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_recommenders_serve_every_labelled_paper(spark, sf_dir, duck):
    served = {r.p_id for r in catalogue.queries()["recommend_heuristic"](spark, sf_dir).select("p_id").collect()}
    assert served == {r[0] for r in duck.execute("select doc_id from labels where quality = 1 and toxic = 1").fetchall()}


def test_every_connector_parses_its_payload(spark, sf_dir):
    from quillgrid.plans import source_queries

    got = {}
    for r in catalogue.queries()["connector_documents"](spark, sf_dir).collect():
        got.setdefault(r.source, []).append(r.title)
    from quillgrid.sources import connectors

    assert set(got) == set(connectors.REGISTRY)
    for source, titles in got.items():
        assert len(titles) == 2, source
        if source != "cve":
            assert all(t.startswith(w) for t, w in zip(sorted(titles), sorted(source_queries.TITLES[source]))), source
