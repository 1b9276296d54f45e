"""Registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert len(catalogue.QUERIES) > 80


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
@pytest.mark.filterwarnings("ignore")
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
