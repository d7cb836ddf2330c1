import importlib
import os
import pkgutil

import pytest

import tidemark.plans
from tests.parity import FOLDER, check

MODULES = [importlib.import_module(f"tidemark.plans.{m.name}") for m in pkgutil.iter_modules(tidemark.plans.__path__)]
QUERIES = {n: f for m in MODULES for n, f in getattr(m, "QUERIES", {}).items()}
ORACLE = {n: s for m in MODULES for n, s in getattr(m, "ORACLE", {}).items()}


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert sum(len(getattr(m, "QUERIES", {})) for m in MODULES) == len(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE.get(name))
