"""Every registered query runs; those with an SQL twin agree with it on the smallest tables."""

from __future__ import annotations

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        result = compare(df, sql, con)
        assert result.startswith("ok") and "TYPES" not in result, result
