import os

import pytest

from tests.emptied import FOLDER, emptied
from tidemark.plans import eval_queries, join_queries, past_queries, problems


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_problem_queries_on_empty_tables(spark, tmp_path):
    d = emptied(tmp_path)
    for name, f in problems.QUERIES.items():
        assert f(spark, d).collect() == [], name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("module", [past_queries, join_queries, eval_queries])
def test_other_queries_do_not_fail_on_empty_tables(spark, tmp_path, module):
    d = emptied(tmp_path)
    for f in module.QUERIES.values():
        f(spark, d).collect()
