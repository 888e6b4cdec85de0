"""Pairs of blocks dealt as a grid of cells, and floats whose halves SQL rounds."""

from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import vector_search
from quillgrid.operators.views import rounded
from quillgrid.plans import catalogue


@pytest.mark.parametrize("whole", [True, False])
def test_cells_of_a_grid_give_what_one_cell_gives(spark, monkeypatch, whole):
    r = np.random.default_rng(5)
    rows = [(i, [0] * 6 if i == 3 else r.integers(-1_000_000, 1_000_000, 6).tolist(), int(i % 5)) for i in range(90)]
    data = spark.createDataFrame(rows, "id long, vector array<int>, year int")
    data = data if whole else data.withColumn("vector", F.col("vector").cast("array<double>"))
    ratings = [vector_search.Rating(3, lambda a, b: a.cosine(b), 0.2), vector_search.Rating(2, lambda a, b: np.where(a.same(b, "year"), -a.cosine(b), -np.inf))]
    got = {}
    for held, cells, size in ((10, 7, 4), (8_192, 1, 500)):
        monkeypatch.setattr(vector_search, "HELD", held)
        monkeypatch.setattr(vector_search, "CELLS", cells)
        out = vector_search.ranked_pairs(data, data, ratings, values=("year",), rows=size)
        got[held] = {(x.kind, x.source_id, x.target_id, x.score) for x in out.collect()}
    assert got[10] == got[8_192] and {k for k, *_ in got[10]} == {0, 1}
    v = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x, _ in rows}
    want = {(0, i, j, s) for i in v for s, j in [(-n, j) for n, j in sorted((-round(float(v[i] @ v[j]), 6), j) for j in v if j != i)[:3]] if s >= 0.2}
    assert {(k, i, j, round(s, 6)) for k, i, j, s in got[10] if k == 0} == want


def test_halves_are_those_of_sql(spark):
    """148.735 is rounded as SQL rounds it."""
    values = [148.735, 7.975, 0.285, 1.005, 2.675, -1.005]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(rounded(F.col("x"), 2)).collect()]
    assert got == [r[0] for x in values for r in duckdb.execute("select round(cast(? as double), 2)", [x]).fetchall()]


@pytest.mark.parametrize("name", ["search_rows", "similar_edges"])
def test_floats_are_those_of_sql(spark, name):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    rel = con.execute(catalogue.oracle_sql()[name])
    columns = sorted(c[0] for c in rel.description)
    theirs = [dict(zip([c[0] for c in rel.description], r, strict=True)) for r in rel.fetchall()]
    plain = lambda r: tuple(round(float(r[c]), 9) if isinstance(r[c], (float, Decimal)) else str(r[c]) for c in columns)
    assert sorted(plain(r.asDict()) for r in catalogue.queries()[name](spark, at).collect()) == sorted(map(plain, theirs))
