"""The queries of the subpackage that SQL can express, on the smallest tables."""

import pytest

from brindle.llm import queries
from tests.conftest import SMALL


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, compare, name):
    compare(queries.queries()[name](spark, str(SMALL)), queries.oracle_sql()[name])


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 14)]
