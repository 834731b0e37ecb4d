"""Every query against its SQL."""

import pytest

from campaignlens.plans import all_queries
from tests.same import duck, same_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same_rows(all_queries.QUERIES[name](spark, sf_dir), con.sql(all_queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert all_queries.QUERIES[name](spark, sf_dir).count() >= 0
