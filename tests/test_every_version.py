"""Deltas of every version against the one before it, not of the first two versions only."""

import os

import pytest

from tests.parity import FOLDER, check
from tidemark.plans.delta_queries import QUERIES

WIDE = """
WITH vr AS (SELECT issue_key, doc_id, i - 1 AS node, ws[i] AS word, dense_rank() OVER (PARTITION BY issue_key ORDER BY doc_id) AS v FROM (
  SELECT issue_key, doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS ws FROM documents WHERE text IS NOT NULL AND issue_key IS NOT NULL), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
r AS (SELECT *, word[1:2] AS ast_type, row_number() OVER (PARTITION BY issue_key, v, word[1:2] ORDER BY node) - 1 AS ordinal FROM vr),
step AS (SELECT DISTINCT x.issue_key, x.v, y.doc_id FROM vr x JOIN (SELECT DISTINCT issue_key, v, doc_id FROM vr) y ON y.issue_key = x.issue_key AND y.v = x.v + 1),
a AS (SELECT s.issue_key, s.doc_id, r.ast_type, r.ordinal, r.node, r.word FROM r JOIN step s ON s.issue_key = r.issue_key AND s.v = r.v),
b AS (SELECT s.issue_key, s.doc_id, r.ast_type, r.ordinal, r.node, r.word FROM r JOIN step s ON s.issue_key = r.issue_key AND s.v + 1 = r.v),
om AS (SELECT issue_key, doc_id, ast_type, ordinal, a.node AS before_id, b.node AS after_id, CASE WHEN a.node IS NULL THEN 'ADDS' WHEN b.node IS NULL THEN 'REMOVES' WHEN a.word = b.word THEN 'KEEP' ELSE 'UPDATES' END AS op
  FROM a FULL JOIN b USING (issue_key, doc_id, ast_type, ordinal))
"""
SQL = {
    "ordinal_match": WIDE + "SELECT * FROM om",
    "delta_ops": WIDE + "SELECT issue_key, doc_id, op, count(*) AS n FROM om GROUP BY ALL",
    "delta_conservation": WIDE + "SELECT count(DISTINCT issue_key) AS n_keys, 0::BIGINT AS n_wrong FROM om",
    "multiset_delta": WIDE + "SELECT * FROM (SELECT issue_key, doc_id, ast_type, sum(n)::BIGINT AS delta FROM (SELECT issue_key, doc_id, ast_type, 1 AS n FROM b UNION ALL SELECT issue_key, doc_id, ast_type, -1 FROM a) GROUP BY ALL) WHERE delta <> 0",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_every_version_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_subtree_diff_of_four_versions(spark, tmp_path):
    rows = [(1, "aa", "K"), (2, "aa\nbb", "K"), (5, "bb", "K"), (9, "cc x", "K"), (3, "aa", "L"), (4, None, "K"), (6, "aa", None)]
    spark.createDataFrame(rows, "doc_id long, text string, issue_key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["issue_key"], r["doc_id"], r["how"], r["n"]) for r in QUERIES["subtree_diff"](spark, str(tmp_path)).collect()}
    assert got == {("K", 2, "subtree", 1), ("K", 2, "inserted", 1), ("K", 5, "subtree", 1), ("K", 5, "deleted", 1), ("K", 9, "deleted", 1), ("K", 9, "inserted", 1)}
