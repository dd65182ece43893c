import os

import pytest

from checks.compare import compare, connect
from kvartal.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, key):
    state, _, _, detail = compare(spark, connect(SMALL), SMALL, key, queries.QUERIES[key], queries.ORACLE_SQL[key])
    assert state == "ok", detail
