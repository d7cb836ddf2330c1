import os

import pytest

from tests.parity import FOLDER, check
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE.get(name))
