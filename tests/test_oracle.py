"""Every query of the catalogue against its SQL."""

import pytest

from lumenrank.plans.catalogue import QUERIES, SQL
from oracle import both, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = both(QUERIES[name](spark, SF), con, SQL[name])
    assert got == want
    assert got
