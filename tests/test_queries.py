"""Every query with SQL gives what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlake import queries


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((repr([rounded(r[c]) for c in columns]) for r in got.collect()))
    names = want.columns
    assert rows == sorted(repr([rounded(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
