"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from harness import compare, connect
from millrace.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    # The smallest document table holds no secrets; every other result has rows.
    assert difference == ("EMPTY" if name == "secrets_scan" else None)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"ml_random_forest", "ml_batch_score"}


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert {"order_year", "order_month", "order_day"} <= set(frame.columns)
