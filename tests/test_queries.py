"""Every query with an oracle against DuckDB on the smallest tables; the others give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from phasegrid.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.8g}")
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    """Rows come out, keyed by what they are about, and no number is missing or infinite in all of them."""
    df = catalog.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    for c, kind in df.dtypes:
        if kind == "double":
            assert any(r[c] is not None and math.isfinite(r[c]) for r in rows), c
    again = catalog.QUERIES[name](spark, DIR).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
