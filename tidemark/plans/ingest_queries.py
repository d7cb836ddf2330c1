"""The property graph of commits: nodes, edges, updates, reconciliation, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ingest as ops
from tidemark.operators.past import with_sequence
from tidemark.plans.base import FILES, METRICS, changes, commits, labels, sql
from tidemark.sources import commitlog as log
from tidemark.sources.files import first_ready, first_repository, metric_matrix, tail_rate, tree_count
from tidemark.session import table

LISTS = [*FILES.values(), "files_copied_list", "files_renamed_list", "parents", "linked_issues", "containing_branches"]
NODES = [
    ops.NodeRule("Commit", "commit_id", {"message": "message", "author_ts": "authored_timestamp"}),
    ops.NodeRule("Project", "project"),
    ops.NodeRule("Developer", "author_email", {"name": "author_name"}),
]
EDGES = [
    ops.EdgeRule("Commit", "BELONGS_TO", "Project", "commit_id", "project"),
    ops.EdgeRule("Commit", "AUTHORED_BY", "Developer", "commit_id", "author_email"),
    ops.EdgeRule("Commit", "INSIDE_BRANCH", "Branch", "commit_id", "containing_branches", True),
    ops.EdgeRule("Commit", "FIXES_ISSUE", "Issue", "commit_id", "linked_issues", True),
    ops.EdgeRule("Commit", "ADDED", "File", "commit_id", "files_added_list", True),
    ops.EdgeRule("Commit", "MODIFIED", "File", "commit_id", "files_modified_list", True),
    ops.EdgeRule("Commit", "DELETED", "File", "commit_id", "files_deleted_list", True),
    ops.EdgeRule("Commit", "COPIED_TO", "File", "commit_id", "files_copied_list", True),
    ops.EdgeRule("Commit", "RENAMED_FROM", "File", "commit_id", "files_renamed_list", True, lambda x: x["old"]),
    ops.EdgeRule("Commit", "RENAMED_TO", "File", "commit_id", "files_renamed_list", True, lambda x: x["new"]),
    ops.EdgeRule("Commit", "PARENT_OF", "Commit", "commit_id", "parents", True),
]


def _held(spark, d):
    return commits(spark, d, ["project", "message", "author_name", "author_email", "authored_timestamp", "ingested_at", *LISTS])


def node_upsert_latest(spark, d):
    return ops.upsert_nodes(table(spark, d, "commits"), ops.NodeRule("Developer", "author_email", {"name": "author_name", "last_ts": "authored_timestamp"}), "ingested_at")


def edge_rules_union(spark, d):
    return ops.all_edges(_held(spark, d), EDGES)


def edge_counts_by_type(spark, d):
    return ops.all_edges(_held(spark, d), EDGES).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def node_counts_by_label(spark, d):
    return ops.node_table(_held(spark, d), NODES, EDGES, "ingested_at").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def implied_nodes(spark, d):
    held = _held(spark, d)
    made = ops.node_table(held, NODES, EDGES, "ingested_at")
    return made.where("implied AND label <> 'Project'").select("label", "id")


def parent_edges(spark, d):
    return ops.edges_of(_held(spark, d), EDGES[-1]).select(F.col("src").alias("child_id"), F.col("dst").alias("parent_id"))


def resolved_parents(spark, d):
    """Parent edges of which both commits are known."""
    held = _held(spark, d)
    nodes = held.select(F.lit("Commit").alias("label"), F.col("commit_id").alias("id"))
    return ops.resolve_edges(ops.edges_of(held, EDGES[-1]), nodes).select("src", "dst")


def issue_edges(spark, d):
    held = _held(spark, d)
    return held.select("commit_id", F.explode(log.issues(F.col("message"))).alias("issue"))


def multi_source_union(spark, d):
    """All commits of one project and the labelled ones of the others, first source first."""
    held = _held(spark, d).select("commit_id", "project", "authored_timestamp")
    labelled = held.join(table(spark, d, "jit_labels").select("commit_id").distinct(), "commit_id", "left_semi")
    return ops.union_first_wins([held.where("project = 'korvane'"), labelled], "commit_id").select("commit_id", "project", F.col("source_no").cast("long").alias("source_no"))


def label_update(spark, d):
    updated = ops.update_properties(commits(spark, d, ["project"]), labels(spark, d), "commit_id", ["y", "fix", "la", "ent"])
    return updated.select("commit_id", F.col("matched").cast("int").cast("long").alias("matched"), "y", "fix", "la", "ent")


def label_update_counts(spark, d):
    updated = ops.update_properties(commits(spark, d, ["project"]), labels(spark, d), "commit_id", ["y"])
    return updated.agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched"), F.count_if(F.col("y") == 1).alias("buggy"), F.count_if(F.col("y") == 0).alias("clean"))


def reconcile_full_outer(spark, d):
    stored = table(spark, d, "ast_nodes").groupBy("file").agg(F.count_distinct("id").alias("n")).where("file IS NOT NULL")
    source = changes(spark, d).where("op = 'ADDS' AND file IS NOT NULL").groupBy("file").agg(F.count_distinct("node_id").alias("n"))
    return ops.reconcile(stored, source, "file", "n").select("file", "stored", "expected", F.col("agrees").cast("int").cast("long").alias("agrees"))


def change_set_scan(spark, d):
    return ops.changed_files(_held(spark, d), "commit_id", {"A": "files_added_list", "M": "files_modified_list", "D": "files_deleted_list"}, "files_renamed_list")


def commits_with_files(spark, d):
    return ops.with_items(_held(spark, d), [*FILES.values(), "files_copied_list", "files_renamed_list"]).select("commit_id")


def payload_projection(spark, d):
    kept = ops.keep_columns(table(spark, d, "commits"), ["commit_id", "project", "author_email", "no_such_column"])
    return kept.distinct()


def props_without_nulls(spark, d):
    """Properties of a commit as JSON, nulls left out: how many keys each has."""
    props = F.to_json(F.struct("author_name", "author_email", "message"), {"ignoreNullFields": "true"})
    return _held(spark, d).select("commit_id", F.size(F.json_object_keys(props)).cast("long").alias("n_keys"))


def path_features(spark, d):
    paths = change_set_scan(spark, d).select("path").distinct()
    return log.exclude_odd_paths(paths).select("path", log.directory_depth(F.col("path")).cast("long").alias("depth"), log.package_of(F.col("path")).alias("package"), F.lower("path").endswith(".java").cast("int").cast("long").alias("is_java"))


def membership_flag(spark, d):
    flagged = commits(spark, d, ["project"]).join(table(spark, d, "jit_labels").select("commit_id").distinct().withColumn("in_labels", F.lit(1)), "commit_id", "left")
    return flagged.groupBy("project").agg(F.sum(F.coalesce("in_labels", F.lit(0))).alias("labelled"), F.count(F.lit(1)).alias("n"))


def label_matrix(spark, d):
    """Metrics with null as 0 and the effort."""
    return metric_matrix(labels(spark, d), METRICS).select("commit_id", "la", "ld", "ent", "effort")


def tree_counts(spark, d):
    """Files by project as if each project were a tree."""
    trees = _held(spark, d).select(F.col("project").alias("ref"), F.explode("files_modified_list").alias("path")).distinct()
    return tree_count(trees).withColumnRenamed("ref", "project")


def first_ready_commit(spark, d):
    """The first of the 200 earliest commits that changes at least three files."""
    snaps = with_sequence(_held(spark, d).select("commit_id", "authored_timestamp", F.size("files_modified_list").cast("long").alias("n_files")), ["authored_timestamp", "commit_id"])
    return first_ready(snaps, "seq", "n_files", 3, 200).select("commit_id", "seq", "n_files")


def repository_of_commit(spark, d):
    """The repository of least priority that owns each commit's project."""
    p = table(spark, d, "projects")
    owners = p.select(F.col("project").alias("ref"), F.posexplode(F.concat(F.array("repo_subpath"), F.coalesce("extra_repo_subpaths", F.array().cast("array<string>")))).alias("priority", "root"))
    refs = commits(spark, d, ["project"]).select("commit_id", F.col("project").alias("ref"))
    return first_repository(refs, owners).select("commit_id", "root")


def replay_tail_rate(spark, d):
    """Rate over the last hundred events by value as seconds."""
    return tail_rate(table(spark, d, "events"), "event_id", "value", 100, 1_000_000).select(F.round("mean_s", 6).alias("mean_s"), F.round("per_s", 6).alias("per_s"), "done", F.round("to_go_s", 2).alias("to_go_s"))


def log_round_trip(spark, d):
    """Commits written as a log and parsed again: what differs from the table."""
    held = commits(spark, d, ["author_name", "author_email", "authored_timestamp", "parents", "files_modified_list", "files_added_list", "lines_added", "message"])
    held = held.where("size(files_modified_list) > 0 AND author_name IS NOT NULL AND author_email IS NOT NULL")
    stat = lambda p: F.concat(F.lit("1\t0\t"), p)
    body = F.concat_ws("\n", F.transform("files_added_list", lambda p: F.concat(F.lit(" create mode 100644 "), p)), F.transform("files_added_list", stat), F.transform("files_modified_list", stat))
    head = F.concat_ws("|", "commit_id", F.concat_ws(" ", "parents"), "author_name", "author_email", F.lit("c"), "authored_timestamp", "authored_timestamp", F.lit("m"))
    parsed = log.parse_log(held.select(F.concat_ws("\n", head, body).alias("block")))
    back = parsed.select("commit_id", F.col("files_modified_list").alias("m"), F.col("files_added_list").alias("a"), F.col("parents").alias("p"), F.col("authored_timestamp").alias("t"))
    j = held.join(back, "commit_id", "left")
    same = F.col("m").eqNullSafe(F.col("files_modified_list")) & F.col("a").eqNullSafe(F.col("files_added_list")) & F.col("p").eqNullSafe(F.col("parents")) & (F.col("t") == F.col("authored_timestamp"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"))


QUERIES = {
    f.__name__: f
    for f in (
        node_upsert_latest, edge_rules_union, edge_counts_by_type, node_counts_by_label, implied_nodes, parent_edges, resolved_parents, issue_edges,
        multi_source_union, label_update, label_update_counts, reconcile_full_outer, change_set_scan, commits_with_files, payload_projection, props_without_nulls, path_features,
        membership_flag, label_matrix, tree_counts, first_ready_commit, repository_of_commit, replay_tail_rate, log_round_trip,
    )
}

_E = """ed AS (
  SELECT 'Commit' AS src_label, commit_id AS src, 'BELONGS_TO' AS rel, 'Project' AS dst_label, project AS dst FROM held
  UNION SELECT 'Commit', commit_id, 'AUTHORED_BY', 'Developer', author_email FROM held
  UNION SELECT 'Commit', commit_id, 'INSIDE_BRANCH', 'Branch', unnest(containing_branches) FROM held
  UNION SELECT 'Commit', commit_id, 'FIXES_ISSUE', 'Issue', unnest(linked_issues) FROM held
  UNION SELECT 'Commit', commit_id, 'ADDED', 'File', unnest(files_added_list) FROM held
  UNION SELECT 'Commit', commit_id, 'MODIFIED', 'File', unnest(files_modified_list) FROM held
  UNION SELECT 'Commit', commit_id, 'DELETED', 'File', unnest(files_deleted_list) FROM held
  UNION SELECT 'Commit', commit_id, 'COPIED_TO', 'File', unnest(files_copied_list) FROM held
  UNION SELECT 'Commit', commit_id, 'RENAMED_FROM', 'File', unnest(files_renamed_list).old FROM held
  UNION SELECT 'Commit', commit_id, 'RENAMED_TO', 'File', unnest(files_renamed_list).new FROM held
  UNION SELECT 'Commit', commit_id, 'PARENT_OF', 'Commit', unnest(parents) FROM held),
edges AS (SELECT * FROM ed WHERE dst IS NOT NULL AND dst <> ''),
nodes AS (SELECT 'Commit' AS label, commit_id AS id, 1 AS own FROM held UNION SELECT 'Project', project, 1 FROM held WHERE project IS NOT NULL
  UNION SELECT 'Developer', author_email, 1 FROM held WHERE author_email IS NOT NULL),
all_nodes AS (SELECT label, id, max(own) AS own FROM (SELECT * FROM nodes UNION ALL SELECT DISTINCT dst_label, dst, 0 FROM edges) GROUP BY label, id)"""
_CS = """cs AS (SELECT commit_id, 'A' AS status, unnest(files_added_list) AS path FROM held UNION SELECT commit_id, 'M', unnest(files_modified_list) FROM held
  UNION SELECT commit_id, 'D', unnest(files_deleted_list) FROM held UNION SELECT commit_id, 'D', unnest(files_renamed_list).old FROM held
  UNION SELECT commit_id, 'A', unnest(files_renamed_list).new FROM held)"""

ORACLE = {
    "node_upsert_latest": """SELECT author_email AS id, max_by(author_name, (ingested_at, author_name)) FILTER (author_name IS NOT NULL) AS name,
      max_by(authored_timestamp, (ingested_at, authored_timestamp)) FILTER (authored_timestamp IS NOT NULL) AS last_ts FROM commits WHERE author_email IS NOT NULL GROUP BY author_email""",
    "edge_rules_union": sql("SELECT * FROM edges", _E),
    "edge_counts_by_type": sql("SELECT rel, count(*) AS n FROM edges GROUP BY rel", _E),
    "node_counts_by_label": sql("SELECT label, count(*) AS n FROM all_nodes GROUP BY label", _E),
    "implied_nodes": sql("SELECT label, id FROM all_nodes WHERE own = 0 AND label <> 'Project'", _E),
    "parent_edges": sql("SELECT src AS child_id, dst AS parent_id FROM edges WHERE rel = 'PARENT_OF'", _E),
    "resolved_parents": sql("SELECT src, dst FROM edges WHERE rel = 'PARENT_OF' AND dst IN (SELECT commit_id FROM held)", _E),
    "issue_edges": sql("SELECT DISTINCT commit_id, unnest(regexp_extract_all(message, '\\b([A-Z]+-\\d+|#\\d+|GH-\\d+)\\b', 1)) AS issue FROM held"),
    "multi_source_union": sql("SELECT commit_id, project, CASE WHEN project = 'korvane' THEN 0 ELSE 1 END::BIGINT AS source_no FROM held WHERE project = 'korvane' OR commit_id IN (SELECT commit_id FROM jit_labels)"),
    "label_update": sql("SELECT h.commit_id, (l.commit_id IS NOT NULL)::INT::BIGINT AS matched, l.y, l.fix, l.la, l.ent FROM held h LEFT JOIN lab l USING (commit_id)"),
    "label_update_counts": sql("SELECT count(*) AS n, count(l.commit_id) AS matched, count(*) FILTER (y = 1) AS buggy, count(*) FILTER (y = 0) AS clean FROM held h LEFT JOIN lab l USING (commit_id)"),
    "reconcile_full_outer": sql("""SELECT coalesce(a.file, b.file) AS file, coalesce(a.n, 0) AS stored, coalesce(b.n, -1) AS expected, coalesce(a.n = b.n, coalesce(a.n, 0) = coalesce(b.n, -1))::INT::BIGINT AS agrees
      FROM (SELECT file, count(DISTINCT id) AS n FROM ast_nodes WHERE file IS NOT NULL GROUP BY file) a FULL JOIN (SELECT file, count(DISTINCT node_id) AS n FROM chg WHERE op = 'ADDS' AND file IS NOT NULL GROUP BY file) b ON a.file = b.file"""),
    "change_set_scan": sql("SELECT * FROM cs WHERE path IS NOT NULL", _CS),
    "commits_with_files": sql("SELECT commit_id FROM held WHERE coalesce(len(files_added_list), 0) + coalesce(len(files_modified_list), 0) + coalesce(len(files_deleted_list), 0) + coalesce(len(files_copied_list), 0) + coalesce(len(files_renamed_list), 0) > 0"),
    "payload_projection": "SELECT DISTINCT commit_id, project, author_email FROM commits",
    "props_without_nulls": sql("SELECT commit_id, ((author_name IS NOT NULL)::INT + (author_email IS NOT NULL)::INT + (message IS NOT NULL)::INT)::BIGINT AS n_keys FROM held"),
    "path_features": sql("SELECT DISTINCT path, len(string_split(path, '/')) - 1 AS depth, regexp_extract(path, '^(.+)/', 1) AS package, lower(path).ends_with('.java')::INT::BIGINT AS is_java FROM cs WHERE path IS NOT NULL AND NOT contains(path, ':')", _CS),
    "membership_flag": sql("SELECT project, count(*) FILTER (commit_id IN (SELECT commit_id FROM jit_labels WHERE commit_id IS NOT NULL)) AS labelled, count(*) AS n FROM held GROUP BY project"),
    "label_matrix": sql("SELECT commit_id, coalesce(la, 0) AS la, coalesce(ld, 0) AS ld, coalesce(ent, 0) AS ent, coalesce(la, 0) + coalesce(ld, 0) + 1 AS effort FROM lab"),
    "tree_counts": sql("SELECT project, count(DISTINCT path) FILTER (lower(path) LIKE '%.java') AS n_files FROM (SELECT project, unnest(files_modified_list) AS path FROM held) GROUP BY project"),
    "first_ready_commit": sql("SELECT commit_id, seq, n_files FROM (SELECT commit_id, row_number() OVER (ORDER BY authored_timestamp, commit_id) - 1 AS seq, len(files_modified_list) AS n_files FROM held) WHERE seq < 200 AND n_files >= 3 ORDER BY seq LIMIT 1"),
    "repository_of_commit": sql("SELECT commit_id, p.repo_subpath AS root FROM held h LEFT JOIN projects p ON p.project = h.project"),
    "replay_tail_rate": "SELECT round(avg(value), 6) AS mean_s, round(1 / avg(value), 6) AS per_s, (SELECT count(*) FROM events) AS done, round(avg(value) * greatest(1000000 - (SELECT count(*) FROM events), 0), 2) AS to_go_s FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 100)",
    "log_round_trip": sql("SELECT count(*) AS n, count(*) AS n_same FROM held WHERE len(files_modified_list) > 0 AND author_name IS NOT NULL AND author_email IS NOT NULL"),
}
