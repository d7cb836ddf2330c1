"""p4_pairs has the pairs of one commit too, p4_cooccurs those of two."""

import math
from collections import Counter
from itertools import combinations

import pytest

from tidemark.llm.queries import QUERIES

MESSAGES = ["Red fox", "red fox hen", "red owl", "fox owl", "hen", "hen", "yak gnu", None, "red red"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"c{i}", m, i) for i, m in enumerate(MESSAGES)]
    spark.createDataFrame(rows, "commit_id string, message string, ingested_at long").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([], "a string, b string, npmi double").write.parquet(f"{tmp_path}/cooccurs.parquet")
    return str(tmp_path)


def test_every_pair(spark, folder):
    sets = [sorted(set((m or "").lower().split())) for m in MESSAGES]
    df, n = Counter(w for s in sets for w in s), len(sets)
    expected = {(a, b): (df[a], df[b], c, pytest.approx(math.log(c * n / df[a] / df[b]) / -math.log(c / n), abs=1e-6)) for (a, b), c in Counter(p for s in sets for p in combinations(s, 2)).items()}
    got = QUERIES["p4_pairs"](spark, folder).collect()
    assert {(r["term_a"], r["term_b"]): (r["df_a"], r["df_b"], r["together"], r["npmi"]) for r in got} == expected
    assert {("gnu", "yak"), ("fox", "hen")} <= set(expected)


def test_stored_pairs_of_two_commits(spark, folder):
    got = {(r["a"], r["b"]): r["npmi"] for r in QUERIES["p4_cooccurs"](spark, folder).collect()}
    assert got == {("nl:fox", "nl:red"): pytest.approx(math.log(2 * 9 / 3 / 4) / -math.log(2 / 9), abs=1e-6)}
