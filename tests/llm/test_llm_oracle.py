"""Queries against their SQL."""

import pytest

from lumenrank.llm.queries import QUERIES, SQL
from oracle import both, tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    got, want = both(QUERIES[name](spark, SF), tables(SF), SQL[name])
    assert got == want and got


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
