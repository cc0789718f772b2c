"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

from cuesheet.plans.registry import all_queries
from oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()
SLOW = {"matched_pairs_channel", "matched_pairs_log"}  # checked against brute force in test_matching


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    message, _, ok = compare(spark, con, SF, QUERIES[name])
    assert ok, message
