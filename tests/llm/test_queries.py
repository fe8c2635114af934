"""Queries against their SQL on the smallest tables."""

import pytest
from imgframe.llm.queries import ORACLE_SQL, QUERIES

from tests.compare import assert_same
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, str(DATA)), duck, ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
