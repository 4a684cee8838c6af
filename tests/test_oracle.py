"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import check  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    verdict, _ = check.compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    assert entry(spark).columns == ["QueryText", "count"]


def test_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
