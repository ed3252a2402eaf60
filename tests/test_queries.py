"""Every query with an oracle gives the same rows in Spark and in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from cadenza import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(engine.oracle_sql()[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
    assert got


@pytest.mark.parametrize("name", ["sc_pca", "rec_mmr", "rec_rank6", "match_fuzzy"])
def test_queries_without_oracle_give_rows(spark, name):
    assert engine.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
