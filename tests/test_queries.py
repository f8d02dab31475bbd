"""Every query with an oracle, at the smallest scale, against DuckDB."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from weft import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v if v is None else str(v)


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(v[i]) for i in at) for v in values], key=str)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in Q.ORACLES:
        made = db.execute(Q.ORACLES[name])
        columns = [d[0] for d in made.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, made.fetchall())
    else:
        assert got
