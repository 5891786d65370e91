"""Every registered query that has SQL gives the rows of that SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from graphloom.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{t}.parquet') else ''}')")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
