"""Every reasoning query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from ontoloom.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in core.queries() if n not in ("el_unsat", "el_role_edges")])
def test_query_equals_its_sql(spark, tables, name):
    got = core.queries()[name](spark, SF)
    want = tables.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda pdf: sorted(map(tuple, pdf[order].astype(str).to_numpy().tolist()))
    assert rows(got.toPandas()) == rows(want)
