"""Every named query against its SQL twin on the smallest data set."""

import math

import duckdb
import pytest

from graphloom.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, database, name):
    df = QUERIES[name](spark, tiny)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    want = database.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted(tuple(plain(r[c]) for c in columns) for r in got)
    right = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
