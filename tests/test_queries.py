"""Every registered query with SQL gives the same values as DuckDB; the others give rows."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    assert compare(spark, db, entry_module.queries()[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert entry_module.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    counts = {r["label"]: r["n"] for r in entry_module.entry(spark).collect()}
    assert len(counts) == 2 and counts[0] == counts[1]
