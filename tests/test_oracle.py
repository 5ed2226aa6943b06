"""Every registered query against its DuckDB oracle on the driver's tables
(sf0.001, and the queries with joins/aggregates also at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.helpers import assert_same

SQL = E.oracle_sql()
Q = E.queries()

MULTI_SCALE = ["star_join", "pk_check", "surrogate_key", "route_conditional", "lineage_crosstab",
               "profile_summary", "profile_topk", "dictionary_domains", "accuracy_sql", "strip_accents"]


def test_every_query_of_the_engine_has_sql():
    """Only training-data keys, an optional subpackage, may go without SQL."""
    from microstar.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(SQL) <= set(Q) and set(catalog.QUERIES) <= set(Q)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle_small(spark, duck_small, name):
    assert_same(Q[name](spark, "/root/testdata/sf0.001"), duck_small, SQL[name])


@pytest.mark.parametrize("name", MULTI_SCALE)
def test_query_matches_oracle_sf001(spark, duck_oracle, name):
    assert_same(Q[name](spark, "/root/testdata/sf0.01"), duck_oracle, SQL[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "o_orderkey" in df.columns and "r_name" in df.columns
