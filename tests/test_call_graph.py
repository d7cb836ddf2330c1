"""The call graph is made of the methods that are defined, not of names that end in e."""

from tidemark.plans.builder_queries import QUERIES

DIFFS = [
    ("c1", "p", "+class A {\n+  void run() {\n+    close();\n+    stop();\n+    stop();\n+  }\n+}"),
    ("c2", "p", "+class B {\n+  void stop() {\n+    run();\n+  }\n+}"),
    ("c3", "q", "+class C {\n+  void other() {\n+    stop();\n+    make();\n+  }\n+  void make() {\n+    a = 1;\n+  }\n+}"),
    ("c4", "q", None),
]


def test_call_graph(spark, tmp_path):
    rows = [(c, p, f"diff --git a/X.java b/X.java\n--- a/X.java\n+++ b/X.java\n@@ -0,0 +1,9 @@\n{t}" if t else None, 1) for c, p, t in DIFFS]
    spark.createDataFrame(rows, "commit_id string, project string, diff string, ingested_at long").write.parquet(f"{tmp_path}/commits.parquet")
    got = {(r["caller"], r["callee"], r["n"]) for r in QUERIES["builder_call_graph"](spark, str(tmp_path)).collect()}
    assert got == {("c1::A::run@2", "c2::B::stop@2", 2), ("c2::B::stop@2", "c1::A::run@2", 1), ("c3::C::other@2", "c3::C::make@6", 1)}
    outside = {(r["project"], r["name"], r["n"]) for r in QUERIES["builder_external_calls"](spark, str(tmp_path)).collect()}
    assert outside == {("p", "close", 1), ("q", "stop", 1)}
