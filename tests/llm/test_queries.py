import pytest
from compare import connect, differences
from conftest import SMALL

from millrace.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    rows, problem = differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])
    assert problem is None and rows > 0


def test_every_dealt_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
