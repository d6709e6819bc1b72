"""The driver's contract: every query runs, and gives the rows of its SQL."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as e

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")

from driftline.plans import catalogue, chain  # noqa: E402

QUERIES, ORACLES = catalogue.QUERIES | chain.QUERIES, catalogue.ORACLES | chain.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(plain(r[k])) for k in at) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, df.collect())
    assert got and got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_names_are_used_once():
    assert not set(catalogue.QUERIES) & set(chain.QUERIES)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
