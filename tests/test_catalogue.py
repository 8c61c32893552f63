"""Every query of the catalogue against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tributary.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain([tuple(r[c] for c in cols) for r in df.collect()])
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = plain(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got == want
