"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from brindle.plans import catalogue
from tests.conftest import SMALL


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, compare, name):
    compare(catalogue.queries()[name](spark, str(SMALL)), catalogue.oracle_sql()[name])


def test_entry_has_sql_for_its_own_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
