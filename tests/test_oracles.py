"""Every registered query against its SQL on the smallest given tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as driver
from tonemill.plans import oracles, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = [p.stem for p in sorted(Path(FOLDER).glob("*.parquet"))]
QUERIES, SQL = registry.QUERIES, oracles.ORACLES
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not TABLES, reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == names
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    places = [relation.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 6
