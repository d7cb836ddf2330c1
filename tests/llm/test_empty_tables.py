import os

import pytest

from tests.emptied import FOLDER, emptied
from tidemark.llm.queries import QUERIES


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_on_empty_tables(spark, tmp_path):
    d = emptied(tmp_path)
    for name, f in QUERIES.items():
        rows = f(spark, d).collect()
        assert rows == [], name
