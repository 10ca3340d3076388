"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.saved == r.raw - r.out for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    message, ok = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok is not False, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
