"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from halyard import market_queries, upkeep_queries  # noqa: F401  they register their queries
from halyard.queries import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"
#: What a lookup gives whose required parameter is null.
EMPTY = {"lookup_required_null"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert ours == theirs
    assert ours or name in EMPTY, "a query without rows shows nothing"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
