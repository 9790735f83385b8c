"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = registered.queries(), registered.oracle_sql()
SLOW = {"train_and_score", "train_and_evaluate"}  # test_tables trains a smaller set


@pytest.fixture(scope="session")
def con():
    return connect(SF_DIR)


def test_names_match():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    if name in CHECKS:
        assert differences(spark, con, QUERIES[name], CHECKS[name], SF_DIR) in (None, "EMPTY")
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
