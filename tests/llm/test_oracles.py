import pytest

from lexforge.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_against_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", registry.queries()[name], registry.oracle_sql()[name]) == ""
