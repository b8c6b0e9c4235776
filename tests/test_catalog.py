"""Every catalogue query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from tallyforge import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, sql, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cur = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = ordered(df.columns, df.collect()), ordered(columns, cur.fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-5)) for a, b in zip(g, w, strict=True)), (g, w)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
