"""Every registered query against DuckDB on the same files, and rows for those without SQL."""

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    if name not in ORACLE_SQL:
        assert got
        return
    cur = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)
