import re

import pytest

from lexforge import catalogue
from tests.oracle import compare

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    where = "/root/testdata/sf0.001"
    if name in SQL:
        assert compare(spark, where, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, where).count() > 0


def test_beginnings_of_words_are_not_broadcast(spark):
    """F2: stem_scores broadcast several rows a word, which the driver had to hold."""
    plan = QUERIES["stem_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[lang#\d+, affix#\d+\], \[lang#\d+, part#\d+\]", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
