"""Each query of the catalogue against its SQL on the smallest tables."""

import os

import pytest

from wavekeep.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ran = oracle.execute(SQL[name])
    have = [c[0] for c in ran.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in ran.fetchall())
