"""The queries of this subpackage against their SQL."""

import math

import duckdb
import pytest

from kinetext.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(normal(r[names.index(c)]) for c in order) for r in want.fetchall()), key=str)
