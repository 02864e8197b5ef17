"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check
from conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.database(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        verdict, _ = check.compare(df, con, SQL[name])
        assert verdict == "ok"
    else:
        assert df.collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
