"""Every registered query with an oracle: Spark vs DuckDB on sf0.001."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    status, detail = compare(spark, con, name, SF)
    assert status == "OK", detail


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns[0] == "column"


def test_every_query_has_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q) and len(q) >= 100
