"""Limits that are the feature are the survey's: 4,000 tokens, 400 members, 25 partners, 2,000 words (T09, T08, T04, T05)."""

import os

import pytest

from tests.parity import FOLDER, check
from tidemark.plans import join_queries, text_queries

QUERIES, ORACLE = join_queries.QUERIES | text_queries.QUERIES, join_queries.ORACLE | text_queries.ORACLE
LIMITS = {"head_tokens": "[1:4000]", "capped_tier_lists": "[1:400]", "cochange_topk": "k <= 25 ", "jitline_vocab": "LIMIT 2000"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(LIMITS))
def test_limit_equals_sql(spark, name):
    assert ORACLE[name].count(LIMITS[name]) == 1 and not ORACLE[name].endswith("LIMIT 200")
    check(spark, QUERIES[name], ORACLE[name])


def test_twelve_members(spark, monkeypatch):
    tier = spark.createDataFrame([("e", "T1", f"f{i:02}") for i in range(12)], "id string, tier string, other string")
    monkeypatch.setattr(join_queries, "hub_events", lambda *a: (None, None))
    monkeypatch.setattr(join_queries, "_imports", lambda *a: None)
    monkeypatch.setattr(join_queries.tiers, "import_tiers", lambda *a: tier)
    assert join_queries.capped_tier_lists(spark, "").collect()[0]["members"].count(";") == 11
