"""Every catalogue query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

from brindle.plans import catalogue, classification, flows, frames, pages, records, relational, search, structures, texts  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in mine.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in theirs.fetchall())
