"""Code graphs of what commits add."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import diff_lines
from tidemark.operators import builders as b
from tidemark.operators import tiers
from tidemark.plans.base import commits


def _added(spark, d):
    """The lines each commit adds, as a piece of code."""
    return commits(spark, d, ["diff"]).where("diff IS NOT NULL").select(F.col("commit_id").alias("file"), diff_lines(F.col("diff"), "+").alias("text"))


def builder_graphs(spark, d):
    return b.build_graphs(_added(spark, d))


def builder_layer_sizes(spark, d):
    return builder_graphs(spark, d).groupBy("layer", "row").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


def builder_method_statistics(spark, d):
    return b.method_statistics(builder_graphs(spark, d))


def _named(spark, d):
    """Calls (caller, called) and definitions (callee, called) of the methods commits add; a name is called within its project."""
    added = _added(spark, d)
    project = commits(spark, d, ["project"]).select(F.col("commit_id").alias("file"), "project")
    method = F.concat_ws("::", "file", "cls", F.concat_ws("@", "method", "line"))
    calls = b.build_calls(added).join(project, "file").select(method.alias("caller"), F.struct("project", "name").alias("called"))
    defs = b.build_methods(added).join(project, "file").select(method.alias("callee"), F.struct("project", F.col("method").alias("name")).alias("called"))
    return calls, defs


def builder_call_graph(spark, d):
    """Calls by name from method to method: each call joined with all definitions of its name in the project."""
    return tiers.resolve_calls(*_named(spark, d), "called")


def builder_external_calls(spark, d):
    """Calls of names that no piece of code of the project defines."""
    return tiers.external_calls(*_named(spark, d), "called").select("called.project", "called.name", "n")


QUERIES = {f.__name__: f for f in (builder_graphs, builder_layer_sizes, builder_method_statistics, builder_call_graph, builder_external_calls)}
ORACLE: dict[str, str] = {}
