import os

import pytest

from sylva.llm import queries
from tests.oracle import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    only_ours, only_theirs, n, m = differences(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert not only_ours and not only_theirs and n == m
