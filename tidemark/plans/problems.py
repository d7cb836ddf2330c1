"""Queries of the general data problems: knowledge at event time, change feeds, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import Events, Statements, known_at_event_time, seconds
from tidemark.operators.changes import Base, Feed, apply_changes, base_state, current_rows, fold_changes, settle
from tidemark.operators.skew import aggregate_balanced, join_fragmented, plan_load
from tidemark.session import durable, table


def _labels_known(spark: SparkSession, d: str, payload: tuple[str, ...]) -> DataFrame:
    reads = table(spark, d, "label_reads").withColumn("at", seconds("author_date"))
    said = table(spark, d, "jit_labels").withColumns({"valid_from": seconds("valid_from"), "known_at": seconds("known_at")})
    return known_at_event_time(
        reads,
        said,
        Events("prior_commit_id", "at", ("read_id", "prior_commit_id", "at")),
        Statements("commit_id", "valid_from", "known_at", "rev_id", payload),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _labels_known(spark, d, ("rev_id",)).where("rev_id IS NOT NULL").select("read_id", "rev_id")


def label_value(c: str):
    """True, False or null of the spellings of a label."""
    word = F.lower(F.trim(F.col(c)))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def p1_labels_at_reads(spark: SparkSession, d: str) -> DataFrame:
    known = _labels_known(spark, d, ("rev_id", "buggy", "valid_from", "known_at"))
    return known.select(
        "read_id", "prior_commit_id", F.col("at").alias("read_at"), "rev_id", "valid_from", "known_at",
        label_value("buggy").cast("int").cast("long").alias("buggy"),
        (F.col("at") - F.col("known_at")).alias("seconds_known"),
    )


_P1 = """
WITH r AS (
  SELECT DISTINCT read_id, prior_commit_id,
    CASE WHEN author_date > 100000000000 THEN author_date // 1000 ELSE author_date END AS read_at FROM label_reads),
s AS (
  SELECT rev_id, commit_id, buggy,
    CASE WHEN valid_from > 100000000000 THEN valid_from // 1000 ELSE valid_from END AS valid_from,
    CASE WHEN known_at > 100000000000 THEN known_at // 1000 ELSE known_at END AS known_at FROM jit_labels),
j AS (
  SELECT r.*, s.rev_id, s.valid_from, s.known_at, s.buggy,
    row_number() OVER (PARTITION BY r.read_id ORDER BY s.valid_from DESC NULLS LAST, s.known_at DESC NULLS LAST, s.rev_id DESC NULLS LAST) AS n
  FROM r LEFT JOIN s ON s.commit_id = r.prior_commit_id AND s.valid_from <= r.read_at AND s.known_at <= r.read_at)
"""

_AST_BASE = Base("id", "file", "alive", {"value": "value"}, {"ast_type": "ast_type", "is_delta": "is_delta"})
_AST_FEED = Feed("change_no", "delivery_id", "op", "node_id", "file", {"value": "new_value"}, {"ast_type": "ast_type", "is_delta": "is_delta"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    state = apply_changes(table(spark, d, "ast_nodes"), table(spark, d, "ast_changes"), _AST_BASE, _AST_FEED)
    return state.select(F.col("key").alias("node_id"), F.col("set_by").alias("delivery_id"))


def _nodes(state: DataFrame) -> DataFrame:
    return state.select(
        F.col("key").alias("node_id"), F.col("grp").alias("file"), "value", "ast_type",
        F.col("is_delta").cast("int").cast("long").alias("is_delta"),
        F.col("alive").cast("int").cast("long").alias("alive"),
    )


def p2_current_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(apply_changes(table(spark, d, "ast_nodes"), table(spark, d, "ast_changes"), _AST_BASE, _AST_FEED, tombstones=True))


def p2_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The nodes after a feed that came in three parts, each folded into the written state of those before.

    Deliveries go to parts by their number, so changes come late and in several parts. What lies below the first half
    of the numbers is settled once two parts are there that have all of it.
    """
    feed = table(spark, d, "ast_changes")
    names = list(_AST_FEED.payload), list(_AST_FEED.fixed)
    half = (feed.agg(F.max("change_no")).collect()[0][0] or 0) // 2
    early = F.col("change_no") <= half
    part = F.pmod("delivery_id", F.lit(3))
    parts = [feed.where((part == 0) | (early & (part == 2))), feed.where((part == 1) & (early | (F.col("change_no") % 2 == 0))), feed.where(~early & ((part == 2) | ((part == 1) & (F.col("change_no") % 2 != 0))))]
    state = durable(fold_changes(parts[0], _AST_FEED, base_state(table(spark, d, "ast_nodes"), _AST_BASE)))
    state = durable(fold_changes(parts[1], _AST_FEED, state))
    state = durable(settle(state, half, *names))
    return _nodes(current_rows(fold_changes(parts[2], _AST_FEED, state, half), *names, tombstones=True))


# The definition as a fold in order of change_no: per node the last removal, then the first ADDS after it.
_P2 = """
WITH once AS (
  SELECT change_no AS seq, delivery_id, upper(trim(op)) AS op, node_id, coalesce(file, split_part(node_id, '::', 1)) AS file, new_value, ast_type, is_delta
  FROM (SELECT *, row_number() OVER (PARTITION BY change_no ORDER BY delivery_id DESC) AS n FROM ast_changes) WHERE n = 1),
start AS (SELECT DISTINCT -1 AS seq, 0 AS delivery_id, CASE WHEN alive THEN 'ADDS' ELSE 'REMOVES' END AS op, id AS node_id, file, value AS new_value, ast_type, is_delta FROM ast_nodes),
facts AS (SELECT * FROM once WHERE node_id IS NOT NULL UNION ALL SELECT * FROM start),
nodes AS (SELECT node_id, max(file) AS file FROM facts WHERE op IN ('ADDS', 'UPDATES', 'REMOVES') GROUP BY node_id),
whole AS (SELECT n.node_id, o.seq, 'REMOVES' AS op, o.delivery_id, n.file, NULL AS new_value, NULL AS ast_type, NULL AS is_delta
  FROM once o JOIN nodes n ON n.file = o.file WHERE o.node_id IS NULL AND o.op = 'REMOVES'),
trail AS (SELECT seq, delivery_id, op, node_id, file, new_value, ast_type, is_delta FROM facts WHERE op IN ('ADDS', 'UPDATES', 'REMOVES')
  UNION ALL SELECT seq, delivery_id, op, node_id, file, new_value, ast_type, is_delta FROM whole),
lives AS (SELECT *, sum(CASE WHEN op = 'REMOVES' THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life,
  sum(CASE WHEN op = 'REMOVES' THEN 1 ELSE 0 END) OVER (PARTITION BY node_id) AS lives FROM trail),
last_life AS (SELECT *, bool_or(op = 'ADDS') OVER (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS up,
  row_number() OVER (PARTITION BY node_id, op ORDER BY seq) AS nth FROM lives WHERE life = lives AND op <> 'REMOVES'),
held AS (SELECT * FROM last_life WHERE (op = 'ADDS' AND nth = 1) OR (op = 'UPDATES' AND up)),
final AS (SELECT node_id, last(delivery_id ORDER BY seq) AS delivery_id, last(new_value ORDER BY seq) AS value,
  first(ast_type ORDER BY seq) AS ast_type, first(is_delta ORDER BY seq) AS is_delta, first(file ORDER BY seq) AS file FROM held GROUP BY node_id)
"""


_P2_NODES = _P2 + """SELECT n.node_id, coalesce(f.file, n.file) AS file, f.value, f.ast_type, f.is_delta::INT::BIGINT AS is_delta,
  (f.node_id IS NOT NULL)::INT::BIGINT AS alive FROM nodes n LEFT JOIN final f USING (node_id)"""


def _by_key(spark: SparkSession, d: str) -> DataFrame:
    """ast_changes once per kind of key, with the columns that the per-key results need."""
    changes = table(spark, d, "ast_changes").select("file", "commit_id", "node_id", "change_no", "delivery_id")
    return changes.select(
        F.explode(
            F.array(
                F.struct(F.lit("file").alias("key_kind"), F.col("file").alias("key_value")),
                F.struct(F.lit("commit_id").alias("key_kind"), F.col("commit_id").alias("key_value")),
            )
        ).alias("k"),
        "node_id", "change_no", "delivery_id",
    ).select("k.*", "node_id", "change_no", "delivery_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 2 percent of all rows. Each row counts once per kind of key, so half of the plan's total is the table's."""
    rows = _by_key(spark, d).select("key_kind", "key_value", "change_no", "delivery_id")
    plan = plan_load(rows, ["key_kind", "key_value"])
    counts = aggregate_balanced(
        rows, plan.keys, {"n": F.count(F.lit(1))}, {"n_rows": F.sum("n")}, spread=["change_no", "delivery_id"], plan=plan
    )
    least = F.lit(plan.total // 2)
    return counts.where(F.col("key_value").isNotNull() & (F.col("n_rows") * 50 >= least)).select("key_kind", "key_value")


def p5_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct nodes and first and last change of every file and every commit."""
    return aggregate_balanced(
        _by_key(spark, d).drop("delivery_id"),
        ["key_kind", "key_value"],
        {"n": F.count(F.lit(1)), "nodes": F.count_distinct("node_id"), "lo": F.min("change_no"), "hi": F.max("change_no")},
        {"n_rows": F.sum("n"), "n_nodes": F.sum("nodes"), "first_change": F.min("lo"), "last_change": F.max("hi")},
        spread=["node_id"],
    )


def p5_depth_against_file(spark: SparkSession, d: str) -> DataFrame:
    """Per file, how many changes lie deeper than the mean depth of the file's nodes before the first change."""
    changes = table(spark, d, "ast_changes").select("file", "depth", "change_no", "delivery_id")
    before = table(spark, d, "ast_nodes").groupBy("file").agg(F.sum("depth").alias("sum_"), F.count("depth").alias("n_"))
    joined = join_fragmented(changes, before, ["file"], "left", spread=["change_no", "delivery_id"])
    deeper = (F.col("depth") * F.col("n_") > F.col("sum_")).cast("int")
    return joined.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(deeper), F.lit(0)).cast("long").alias("n_deeper"))


QUERIES = {
    "p1_found": p1_found,
    "p1_labels_at_reads": p1_labels_at_reads,
    "p2_found": p2_found,
    "p2_current_nodes": p2_current_nodes,
    "p2_in_parts": p2_in_parts,
    "p5_found": p5_found,
    "p5_per_key": p5_per_key,
    "p5_depth_against_file": p5_depth_against_file,
}

ORACLE = {
    "p1_found": _P1 + "SELECT read_id, rev_id FROM j WHERE n = 1 AND rev_id IS NOT NULL",
    "p1_labels_at_reads": _P1
    + """SELECT read_id, prior_commit_id, read_at, rev_id, valid_from, known_at,
      CASE WHEN lower(trim(buggy)) IN ('true', '1') THEN 1 WHEN lower(trim(buggy)) IN ('false', '0') THEN 0 END::BIGINT AS buggy,
      read_at - known_at AS seconds_known FROM j WHERE n = 1""",
    "p2_found": _P2 + "SELECT node_id, delivery_id FROM final",
    "p2_current_nodes": _P2_NODES,
    "p2_in_parts": _P2_NODES,
    "p5_found": """
      SELECT 'file' AS key_kind, file AS key_value FROM ast_changes WHERE file IS NOT NULL GROUP BY file
        HAVING count(*) * 50 >= (SELECT count(*) FROM ast_changes)
      UNION ALL SELECT 'commit_id', commit_id FROM ast_changes WHERE commit_id IS NOT NULL GROUP BY commit_id
        HAVING count(*) * 50 >= (SELECT count(*) FROM ast_changes)""",
    "p5_per_key": """
      SELECT 'file' AS key_kind, file AS key_value, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes, min(change_no) AS first_change, max(change_no) AS last_change
      FROM ast_changes GROUP BY file
      UNION ALL SELECT 'commit_id', commit_id, count(*), count(DISTINCT node_id), min(change_no), max(change_no) FROM ast_changes GROUP BY commit_id""",
    "p5_depth_against_file": """
      WITH b AS (SELECT file, avg(depth) AS mean_depth FROM ast_nodes GROUP BY file)
      SELECT c.file, count(*) AS n_rows, count(*) FILTER (WHERE c.depth > b.mean_depth) AS n_deeper FROM ast_changes c LEFT JOIN b ON b.file = c.file GROUP BY c.file""",
}
