"""Every base query against its SQL, on the smallest tables."""

import pytest

from imgframe.plans import ORACLE_SQL, QUERIES
from tests.compare import assert_same
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, str(DATA)), duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
