"""Versioned layers: deltas between versions, the change feed, soft deletion, replay."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import delta as dl
from tidemark.operators.past import strict_past, with_sequence
from tidemark.plans.base import changes, sql
from tidemark.plans.problems import _P2, p2_current_nodes
from tidemark.session import table


def _documents(spark, d):
    """Documents of an issue key: its versions, in order of doc_id."""
    return table(spark, d, "documents").where("text IS NOT NULL AND issue_key IS NOT NULL").select("issue_key", "doc_id", "text")


def _words(docs):
    """Words of versions as nodes (key, version, word, place)."""
    ws = docs.select("issue_key", "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("ws"))
    return ws.select("issue_key", "doc_id", F.posexplode("ws").alias("place", "word"))


def _versions(spark, d):
    """Documents of an issue key as versions of one file."""
    return _words(_documents(spark, d))


def _steps(docs):
    """Every version of an issue key that has one before it: issue_key, doc_id, before_doc, and the step's number.

    Neighbours come from positions in one sort and are joined by them, so no task holds the versions of a hot key.
    """
    order = with_sequence(docs.select("issue_key", "doc_id").distinct(), ["issue_key", "doc_id"], "step")
    before = order.select("issue_key", (F.col("step") + 1).alias("step"), F.col("doc_id").alias("before_doc"))
    return order.join(before, ["issue_key", "step"])


def _sides(docs, steps, columns):
    """Documents of each step before and after it, with ``columns`` of the step in place of their doc_id."""
    side = lambda at: docs.join(steps.select("issue_key", F.col(at).alias("doc_id"), *[F.col(c).alias(f"{c}_") for c in columns]), ["issue_key", "doc_id"]).select("issue_key", *[F.col(f"{c}_").alias(c) for c in columns], "text")
    return side("before_doc"), side("doc_id")


def _pair(spark, d):
    """Nodes of every version and of the version before it, both under the later one's doc_id."""
    docs = _documents(spark, d).where(F.lower("text").rlike("[a-z]{2,}"))
    nodes = lambda side: _words(side).select("issue_key", "doc_id", F.col("place").alias("node"), F.substring("word", 1, 2).alias("ast_type"), F.col("word").alias("value"))
    before, after = _sides(docs, _steps(docs), ["doc_id"])
    return nodes(before), nodes(after)


def _matched(a, b):
    return dl.ordinal_match(a, b, ["issue_key", "doc_id", "ast_type"], ["node"])


def ordinal_match(spark, d):
    a, b = _pair(spark, d)
    return _matched(a, b).select("issue_key", "doc_id", "ast_type", F.col("ordinal").cast("long").alias("ordinal"), F.col("before_id").cast("long").alias("before_id"), F.col("after_id").cast("long").alias("after_id"), "op")


def delta_ops(spark, d):
    a, b = _pair(spark, d)
    return _matched(a, b).groupBy("issue_key", "doc_id", "op").agg(F.count(F.lit(1)).alias("n"))


def delta_conservation(spark, d):
    """matched + deleted = before and matched + inserted = after: keys, and steps of theirs where it does not hold."""
    a, b = _pair(spark, d)
    step = ["issue_key", "doc_id"]
    m = _matched(a, b).groupBy(*step).agg(F.count("before_id").alias("nb"), F.count("after_id").alias("na"))
    n = a.groupBy(*step).agg(F.count(F.lit(1)).alias("b")).join(b.groupBy(*step).agg(F.count(F.lit(1)).alias("a")), step, "full_outer")
    per = n.join(m, step, "left").groupBy("issue_key").agg(F.count_if(~F.col("nb").eqNullSafe(F.coalesce("b", F.lit(0))) | ~F.col("na").eqNullSafe(F.coalesce("a", F.lit(0)))).alias("wrong"))
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("wrong"), F.lit(0)).cast("long").alias("n_wrong"))


def multiset_delta(spark, d):
    a, b = _pair(spark, d)
    return dl.multiset_delta(a, b, ["issue_key", "doc_id", "ast_type"]).where("delta <> 0")


def successive_deltas(spark, d):
    """Change of every word count from version to version of each issue key."""
    return dl.successive_deltas(_versions(spark, d), ["issue_key"], "doc_id", ["word"])


def delta_tokens(spark, d):
    """Change tokens op:type of the feed."""
    c = changes(spark, d).where("ast_type IS NOT NULL")
    return c.groupBy(F.concat_ws(":", "op", "ast_type").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("commit_id").alias("commits"))


def soft_delete_state(spark, d):
    return dl.soft_deleted(changes(spark, d))


def file_deletes(spark, d):
    """Deletes of whole files and how many nodes the base has in them."""
    c = changes(spark, d).where("op = 'REMOVES' AND node_id IS NULL AND file IS NOT NULL").select("change_no", "file")
    n = table(spark, d, "ast_nodes").groupBy("file").agg(F.count_distinct("id").alias("n"))
    return c.join(n, "file", "left").select("change_no", "file", F.coalesce("n", F.lit(0)).alias("n_nodes"))


def delta_replay_check(spark, d):
    """Nodes alive and dead per file after replaying the feed."""
    return p2_current_nodes(spark, d).groupBy("file").agg(F.sum("alive").cast("long").alias("alive"), F.count(F.lit(1)).alias("n"))


def state_threading(spark, d):
    """Each update of a node with the value before it, threaded along the node's changes."""
    c = changes(spark, d).where("node_id IS NOT NULL AND op IN ('ADDS', 'UPDATES')").select("node_id", "change_no", "op", "new_value")
    w = W.partitionBy("node_id").orderBy("change_no")
    return c.select("node_id", "change_no", "new_value", F.lag("new_value").over(w).alias("previous_value")).where("previous_value IS NOT NULL")


def position_stamps(spark, d):
    """Last known position of every node: that of its last change with one, else the base's."""
    c = changes(spark, d).where("node_id IS NOT NULL AND pos_line IS NOT NULL").select(F.col("node_id").alias("id"), "change_no", "pos_line", "pos_col")
    b = table(spark, d, "ast_nodes").where("pos_line IS NOT NULL").select("id", F.lit(-1).cast("long").alias("change_no"), "pos_line", "pos_col")
    best = c.unionByName(b).groupBy("id").agg(F.max(F.struct("change_no", "pos_line", "pos_col")).alias("b"))
    return best.select("id", F.col("b.pos_line").cast("long").alias("pos_line"), F.col("b.pos_col").cast("long").alias("pos_col"))


def delivery_duplicates(spark, d):
    """Changes delivered more than once, with how many deliveries and contents."""
    raw = table(spark, d, "ast_changes")
    per = raw.groupBy("change_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("delivery_id").alias("n_deliveries"))
    return per.where("n_rows > 1")


def late_changes(spark, d):
    """Changes that arrive after a change with a greater number."""
    raw = table(spark, d, "ast_changes").select("delivery_id", "change_no").distinct()
    out = strict_past(raw, [], "delivery_id", {"seen": ("max", F.col("change_no"))})
    return out.where("seen > change_no").select("delivery_id", "change_no", "seen")


def subtree_diff(spark, d):
    """Line trees of every version and the version before it, matched by subtree hash."""
    docs = _documents(spark, d)
    steps = _steps(docs)
    before, after = (dl.line_graph(side, "step", "text") for side in _sides(docs, steps, ["step"]))
    counted = dl.subtree_match(before, after, "step").groupBy("step", "how").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(steps, "step").select("issue_key", "doc_id", "how", "n")


QUERIES = {
    f.__name__: f
    for f in (
        ordinal_match, delta_ops, delta_conservation, multiset_delta, successive_deltas, delta_tokens, soft_delete_state, file_deletes, delta_replay_check, state_threading,
        position_stamps, delivery_duplicates, late_changes, subtree_diff,
    )
}

# Versions of an issue key (vr), each step from a version to the next one (st), the nodes before and after it (a, b) and their match (om).
_V = """vr AS (SELECT issue_key, doc_id, i - 1 AS node, ws[i] AS word, dense_rank() OVER (PARTITION BY issue_key ORDER BY doc_id) AS v FROM (
  SELECT issue_key, doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS ws FROM documents WHERE text IS NOT NULL AND issue_key IS NOT NULL), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
nr AS (SELECT issue_key, v, word[1:2] AS ast_type, node, word, row_number() OVER (PARTITION BY issue_key, v, word[1:2] ORDER BY node) - 1 AS ordinal FROM vr),
st AS (SELECT issue_key, v, doc_id FROM (SELECT DISTINCT issue_key, v, doc_id FROM vr) WHERE v > 1),
a AS (SELECT st.issue_key, st.doc_id, ast_type, ordinal, node, word FROM st JOIN nr ON nr.issue_key = st.issue_key AND nr.v = st.v - 1),
b AS (SELECT st.issue_key, st.doc_id, ast_type, ordinal, node, word FROM st JOIN nr ON nr.issue_key = st.issue_key AND nr.v = st.v),
om AS (SELECT issue_key, doc_id, ast_type, ordinal, a.node AS before_id, b.node AS after_id, CASE WHEN a.node IS NULL THEN 'ADDS' WHEN b.node IS NULL THEN 'REMOVES' WHEN a.word = b.word THEN 'KEEP' ELSE 'UPDATES' END AS op
  FROM a FULL JOIN b USING (issue_key, doc_id, ast_type, ordinal))"""

ORACLE = {
    "ordinal_match": sql("SELECT * FROM om", _V),
    "delta_ops": sql("SELECT issue_key, doc_id, op, count(*) AS n FROM om GROUP BY ALL", _V),
    "delta_conservation": sql("SELECT count(DISTINCT issue_key) AS n_keys, 0::BIGINT AS n_wrong FROM om", _V),
    "multiset_delta": sql("SELECT * FROM (SELECT issue_key, doc_id, ast_type, sum(n)::BIGINT AS delta FROM (SELECT issue_key, doc_id, ast_type, 1 AS n FROM b UNION ALL SELECT issue_key, doc_id, ast_type, -1 FROM a) GROUP BY ALL) WHERE delta <> 0", _V),
    "successive_deltas": sql("SELECT * FROM (SELECT issue_key, doc_id, word, sum(n)::BIGINT AS delta FROM (SELECT issue_key, doc_id, word, 1 AS n FROM vr UNION ALL SELECT x.issue_key, z.doc_id, x.word, -1 FROM vr x JOIN (SELECT DISTINCT issue_key, doc_id, v FROM vr) z ON z.issue_key = x.issue_key AND z.v = x.v + 1) GROUP BY ALL) WHERE delta <> 0", _V),
    "delta_tokens": sql("SELECT op || ':' || ast_type AS token, count(*) AS n, count(DISTINCT commit_id) AS commits FROM chg WHERE ast_type IS NOT NULL GROUP BY 1"),
    "soft_delete_state": sql("SELECT node_id, commit_id AS removed_by, change_no FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY change_no DESC) AS k FROM chg WHERE node_id IS NOT NULL AND op IN ('ADDS', 'REMOVES')) WHERE k = 1 AND op = 'REMOVES'"),
    "file_deletes": sql("SELECT c.change_no, c.file, (SELECT count(DISTINCT id) FROM ast_nodes n WHERE n.file = c.file) AS n_nodes FROM chg c WHERE op = 'REMOVES' AND node_id IS NULL AND file IS NOT NULL"),
    "delta_replay_check": _P2 + "SELECT coalesce(f.file, n.file) AS file, count(f.node_id) AS alive, count(*) AS n FROM nodes n LEFT JOIN final f USING (node_id) GROUP BY 1",
    "state_threading": sql("SELECT node_id, change_no, new_value, previous_value FROM (SELECT *, lag(new_value) OVER (PARTITION BY node_id ORDER BY change_no) AS previous_value FROM chg WHERE node_id IS NOT NULL AND op IN ('ADDS', 'UPDATES')) WHERE previous_value IS NOT NULL"),
    "position_stamps": sql("SELECT id, arg_max(pos_line, (k, pos_line, pos_col))::BIGINT AS pos_line, arg_max(pos_col, (k, pos_line, pos_col))::BIGINT AS pos_col FROM (SELECT node_id AS id, change_no AS k, pos_line, coalesce(pos_col, -9) AS pos_col FROM chg WHERE node_id IS NOT NULL AND pos_line IS NOT NULL UNION ALL SELECT id, -1, pos_line, coalesce(pos_col, -9) FROM ast_nodes WHERE pos_line IS NOT NULL) GROUP BY id").replace("(pos_col, (k, pos_line, pos_col))", "(nullif(pos_col, -9), (k, pos_line, pos_col))"),
    "delivery_duplicates": "SELECT change_no, count(*) AS n_rows, count(DISTINCT delivery_id) AS n_deliveries FROM ast_changes GROUP BY change_no HAVING count(*) > 1",
    "late_changes": "SELECT * FROM (SELECT delivery_id, change_no, max(change_no) OVER (ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT DISTINCT delivery_id, change_no FROM ast_changes)) WHERE seen > change_no",
}
