"""Every registered query that SQL can express against DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else x if isinstance(x, str) else float(x)
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n in QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    ours, theirs = rows(QUERIES[name](spark, sf).toPandas()), rows(duck.sql(ORACLES[name]).to_arrow_table().to_pandas())
    assert ours[0] == theirs[0] and len(ours[1]) == len(theirs[1])
    for a, b in zip(ours[1], theirs[1]):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def test_oracles_have_queries():
    assert not set(ORACLES) - set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
