"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from concord.demo.oracle import ORACLE
from concord.demo.queries import QUERIES
from comparing import TESTDATA, assert_same, duck

FOLDER = TESTDATA / os.environ.get("CONCORD_TEST_SF", "sf0.01")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, connection, name):
    result = __spark_entry__.queries()[name](spark, str(FOLDER))
    assert_same(result, connection, __spark_entry__.oracle_sql()[name])


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert (row.source_rows, row.target_rows, row.matched, row.changed) == (1500, 1479, 1337, 120)
    assert (row.missing_from_target, row.missing_from_source, row.reassigned) == (31, 10, 12)
