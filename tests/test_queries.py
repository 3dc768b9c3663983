"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from phonosearch.plans import build_queries, search_queries

SF = "/root/testdata/sf0.001"
ORACLES = search_queries.ORACLES | build_queries.ORACLES
QUERIES = search_queries.QUERIES | build_queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings benchmark conversations events".split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(columns)
    return sorted((tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
