"""Every registered query against its DuckDB oracle on the driver's tables."""

import os

import pytest

from marginkit import catalog, oracle
from oracle_compare import compare, duck

SF_DIR = os.environ.get("MARGINKIT_TEST_SF", "/root/testdata/sf0.001")
KEYS = list(catalog.queries())
#: keys without a row in the smallest tables
LARGER, LARGER_DIR = {"null_rows"}, "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_key_has_an_oracle_or_is_rows_only():
    missing = set(KEYS) - set(oracle.oracle_sql())
    assert missing == {"score_margin"}
    assert set(oracle.oracle_sql()) <= set(KEYS)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    if key in LARGER:
        r = compare(spark, key, LARGER_DIR, duck(LARGER_DIR))
    else:
        r = compare(spark, key, SF_DIR, con)
    assert r["status"] in ("match", "rows-only"), r
    assert r["spark_rows"] > 0, r
