"""Every query of the engine against its DuckDB SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from conftest import SF

from corpusmill import registry

ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


def norm(v):
    if isinstance(v, float) or hasattr(v, "quantize"):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    made = registry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in made.collect()), key=repr)
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
