import os

import pytest

from sylva.plans import catalog
from tests.oracle import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    only_ours, only_theirs, n, m = differences(spark, catalog.queries()[name], catalog.oracle_sql()[name])
    assert not only_ours and not only_theirs and n == m


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 45
