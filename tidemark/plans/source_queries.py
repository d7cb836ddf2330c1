"""Readers and writers, by round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.base import commits, events, labels, sql
from tidemark.session import scratch, table
from tidemark.sources import commitlog as log
from tidemark.sources import files


def label_csv_scan(spark, d):
    """Labels written as the CSV the study reads, scanned with pruned columns and a filter, and typed."""
    path = scratch(spark, "labels")
    flag = lambda c: F.when(F.col(c) == 1, "True").when(F.col(c) == 0, "False")
    out = labels(spark, d).join(commits(spark, d, ["project"]), "commit_id")
    files.write_long_csv(out.select("commit_id", "project", flag("y").alias("buggy"), flag("fix").alias("fix"), "year", "author_date", "la", "ld", "ent"), path)
    back = files.typed_labels(files.read_labels(spark, path)).where("project = 'korvane'")
    return back.select("commit_id", F.col("buggy").cast("int").cast("long").alias("buggy"), "year", "author_date", "la", F.round("ent", 6).alias("ent"))


def log_file_scan(spark, d):
    """A log written as one text, read block by block and parsed."""
    path = scratch(spark, "log")
    held = commits(spark, d, ["author_name", "author_email", "authored_timestamp", "parents", "files_modified_list"])
    held = held.where("size(files_modified_list) > 0 AND author_name IS NOT NULL AND author_email IS NOT NULL")
    head = F.concat_ws("|", "commit_id", F.concat_ws(" ", "parents"), "author_name", "author_email", F.lit("c"), "authored_timestamp", "authored_timestamp", F.lit("m"))
    body = F.concat_ws("\n", F.transform("files_modified_list", lambda p: F.concat(F.lit("2\t1\t"), p)))
    held.select(F.concat(F.lit(log.DELIMITER), F.concat_ws("\n", head, body)).alias("value")).write.text(path)
    parsed = log.parse_log(log.read_log(spark, path))
    return parsed.select("commit_id", "author_email", F.size("files_modified_list").cast("long").alias("n_files"), "lines_added", "lines_deleted", "max_directory_depth")


def snapshot_versions(spark, d):
    """Two versions of a table side by side, with the rows of each."""
    root = scratch(spark, "snapshots")
    nodes = table(spark, d, "ast_nodes").select("id", "file").distinct()
    files.write_snapshot(nodes, root, "nodes", "1")
    files.write_snapshot(nodes.where("file IS NOT NULL AND file LIKE 'korvane%'"), root, "nodes", "2")
    return files.read_snapshot(spark, root, "nodes").groupBy(F.col("version").cast("long").alias("version")).agg(F.count(F.lit(1)).alias("n"))


def partition_reset(spark, d):
    """One partition of a layer table replaced, the others kept."""
    path = scratch(spark, "layer")
    nodes = table(spark, d, "ast_nodes").where("node_group IS NOT NULL").select("id", "node_group").distinct()
    files.overwrite_partition(nodes, path, ["node_group"])
    files.overwrite_partition(nodes.where("node_group = 'leaf'").limit(1).withColumn("id", F.lit("only")), path, ["node_group"])
    return spark.read.parquet(path).groupBy("node_group").agg(F.count(F.lit(1)).alias("n"))


def json_metrics(spark, d):
    """Counts per project written as JSON and read again."""
    path = scratch(spark, "json")
    files.write_json(events(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")), path)
    return spark.read.schema("project string, n long, bad long").json(path)


def cached_table(spark, d):
    """A computed table that the second call only reads."""
    path = scratch(spark, "cache")
    make = lambda: table(spark, d, "ast_changes").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    files.cached(spark, path, make)
    return files.cached(spark, path, make)


QUERIES = {f.__name__: f for f in (label_csv_scan, log_file_scan, snapshot_versions, partition_reset, json_metrics, cached_table)}

ORACLE = {
    "label_csv_scan": sql("SELECT l.commit_id, l.y AS buggy, l.year::BIGINT AS year, l.author_date, l.la::BIGINT AS la, round(l.ent, 6) AS ent FROM lab l JOIN held h USING (commit_id) WHERE h.project = 'korvane'"),
    "log_file_scan": sql("SELECT commit_id, author_email, len(files_modified_list) AS n_files, 2 * len(files_modified_list) AS lines_added, len(files_modified_list) AS lines_deleted, list_max(list_transform(files_modified_list, lambda p: len(string_split(p, '/')) - 1)) AS max_directory_depth FROM held WHERE len(files_modified_list) > 0 AND author_name IS NOT NULL AND author_email IS NOT NULL"),
    "snapshot_versions": "SELECT 1::BIGINT AS version, count(*) AS n FROM (SELECT DISTINCT id, file FROM ast_nodes) UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT id, file FROM ast_nodes WHERE file LIKE 'korvane%')",
    "partition_reset": "SELECT node_group, CASE WHEN node_group = 'leaf' THEN 1 ELSE count(DISTINCT id) END AS n FROM ast_nodes WHERE node_group IS NOT NULL GROUP BY node_group",
    "json_metrics": sql("SELECT project, count(*) AS n, sum(y)::BIGINT AS bad FROM ev GROUP BY project"),
    "cached_table": "SELECT file, count(*) AS n FROM ast_changes GROUP BY file",
}
