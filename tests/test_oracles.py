"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from compare import connect, differences

from millrace.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        rows, problem = differences(frame, oracle, ORACLES[name])
        assert problem is None, problem
        assert rows > 0
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
