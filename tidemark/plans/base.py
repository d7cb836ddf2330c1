"""The commit stream of the test tables, as Spark frames and as the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import seconds
from tidemark.operators.latest import latest_rows
from tidemark.operators.past import with_sequence
from tidemark.plans.problems import label_value
from tidemark.session import table

METRICS = ["la", "ld", "nf", "nd", "ns", "ent", "ndev", "age", "nuc", "aexp", "arexp", "asexp"]
FILES = {"ADDED": "files_added_list", "MODIFIED": "files_modified_list", "DELETED": "files_deleted_list"}


def commits(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return latest_rows(table(spark, d, "commits"), "commit_id", "ingested_at", columns)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The statement of each commit that holds at the end of time."""
    said = table(spark, d, "jit_labels").withColumns({"valid_from": seconds("valid_from"), "known_at": seconds("known_at"), "author_date": seconds("author_date")})
    best = F.max(F.struct("valid_from", "known_at", "rev_id", "buggy", "fix", "year", "author_date", *METRICS)).alias("b")
    held = said.where("commit_id IS NOT NULL").groupBy("commit_id").agg(best)
    return held.select("commit_id", label_value("b.buggy").cast("int").cast("long").alias("y"), label_value("b.fix").cast("int").cast("long").alias("fix"), "b.year", "b.author_date", *[f"b.{m}" for m in METRICS])


def events(spark: SparkSession, d: str, columns: tuple[str, ...] = (), metrics: tuple[str, ...] = ()) -> DataFrame:
    """Labelled commits in order of (ts, id): id, seq, ts, y, actor, project, further columns."""
    held = commits(spark, d, ["authored_timestamp", "author_name", "project", *[c for c in columns if c != "project"]])
    said = labels(spark, d).where("y IS NOT NULL").select("commit_id", "y", *metrics)
    joined = held.join(said, "commit_id").withColumnsRenamed({"commit_id": "id", "authored_timestamp": "ts", "author_name": "actor"})
    return with_sequence(joined, ["ts", "id"])


def hub_rows(ev: DataFrame) -> DataFrame:
    """Distinct (id, seq, ts, y, actor, hub) of added, modified and deleted files; ``ev`` has their lists."""
    lists = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in FILES.values()])
    return ev.select("id", "seq", "ts", "y", "actor", F.explode(F.array_distinct(lists)).alias("hub")).where("hub IS NOT NULL")


def hub_events(spark: SparkSession, d: str, metrics: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d, tuple(FILES.values()), metrics)
    return ev.drop(*FILES.values()), hub_rows(ev)


def changes(spark: SparkSession, d: str) -> DataFrame:
    """ast_changes once per change_no, with clean op: the content of the greatest delivery."""
    raw = table(spark, d, "ast_changes")
    rest = [c for c in raw.columns if c not in ("change_no", "delivery_id")]
    once = raw.groupBy("change_no").agg(F.max(F.struct("delivery_id", *rest)).alias("b")).select("change_no", "b.*")
    return once.withColumn("op", F.upper(F.trim("op")))


# Warm-up w, block length m and block starts s of the stream, as tidemark.spec.PROTOCOL has them.
PROTOCOL_SQL = """pc AS (SELECT count(*) AS n, floor(0.05 * count(*))::BIGINT AS w, greatest(200, ceil(count(*) / 100.0))::BIGINT AS m FROM ev),
st AS MATERIALIZED (SELECT s, m FROM (SELECT unnest(range(w, n, m)) AS s, m FROM pc))"""

SQL = """
held AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC) AS rn FROM commits WHERE commit_id IS NOT NULL) WHERE rn = 1),
said AS (SELECT * EXCLUDE (valid_from, known_at, author_date), CASE WHEN valid_from > 100000000000 THEN valid_from // 1000 ELSE valid_from END AS vf,
  CASE WHEN known_at > 100000000000 THEN known_at // 1000 ELSE known_at END AS ka, CASE WHEN author_date > 100000000000 THEN author_date // 1000 ELSE author_date END AS author_date FROM jit_labels),
lab AS (SELECT * EXCLUDE (rn, buggy, fix), CASE WHEN lower(trim(buggy)) IN ('true', '1') THEN 1 WHEN lower(trim(buggy)) IN ('false', '0') THEN 0 END::BIGINT AS y,
  CASE WHEN lower(trim(fix)) IN ('true', '1') THEN 1 WHEN lower(trim(fix)) IN ('false', '0') THEN 0 END::BIGINT AS fix
  FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY vf DESC, ka DESC, rev_id DESC) AS rn FROM said WHERE commit_id IS NOT NULL) WHERE rn = 1),
ev AS (SELECT h.commit_id AS id, row_number() OVER (ORDER BY h.authored_timestamp, h.commit_id) - 1 AS seq, h.authored_timestamp AS ts, l.y, h.author_name AS actor, h.project,
  h.message, h.diff, h.files_added_list, h.files_modified_list, h.files_deleted_list, l.fix, l.la, l.ld, l.nf, l.nd, l.ns, l.ent, l.ndev, l.age, l.nuc, l.aexp, l.arexp, l.asexp
  FROM held h JOIN lab l USING (commit_id) WHERE l.y IS NOT NULL),
hub AS (SELECT DISTINCT id, seq, ts, y, actor, unnest(list_concat(files_added_list, files_modified_list, files_deleted_list)) AS hub FROM ev),
chg AS (SELECT * EXCLUDE (rn, op), upper(trim(op)) AS op FROM (SELECT *, row_number() OVER (PARTITION BY change_no ORDER BY delivery_id DESC) AS rn FROM ast_changes) WHERE rn = 1)
"""


def sql(body: str, *parts: str) -> str:
    """A query on the common views: ``parts`` are further WITH entries, ``body`` the final SELECT."""
    return "WITH " + ",".join([SQL, *parts]) + body
