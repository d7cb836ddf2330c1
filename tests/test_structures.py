"""Graph ingest, tiers, deltas, text functions, streams and models on small made-up tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import text as tx
from tidemark.operators import delta as dl
from tidemark.operators import ingest, tiers
from tidemark.operators import model as ml
from tidemark.operators import textgraph as tg
from tidemark.operators.latest import latest_rows
from tidemark.streaming import events as st


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 9, "q"), ("a", 2, "z")], "k string, o int, v string")
    assert {tuple(r) for r in latest_rows(df, "k", "o", ["v"]).collect()} == {("a", "z"), ("b", "n")}
    assert latest_rows(df.limit(0), "k", "o", ["v"]).collect() == []


def test_nodes_edges_and_implied_targets(spark):
    df = spark.createDataFrame([("c1", 1, "m1", ["f1", None, "", "f1"], "d1"), ("c1", 2, None, ["f2"], "d1"), (None, 3, "lost", ["f9"], None)], "id string, o int, msg string, files array<string>, dev string")
    nodes = [ingest.NodeRule("Commit", "id", {"msg": "msg"})]
    edges = [ingest.EdgeRule("Commit", "TOUCHED", "File", "id", "files", True), ingest.EdgeRule("Commit", "BY", "Dev", "id", "dev")]
    assert [tuple(r) for r in ingest.upsert_nodes(df, nodes[0], "o").collect()] == [("c1", "m1")]
    assert {(r["src"], r["rel"], r["dst"]) for r in ingest.all_edges(df, edges).collect()} == {("c1", "TOUCHED", "f1"), ("c1", "TOUCHED", "f2"), ("c1", "BY", "d1")}
    table = {(r["label"], r["id"]): r["props"] for r in ingest.node_table(df, nodes, edges, "o").collect()}
    assert table == {("Commit", "c1"): {"msg": "m1"}, ("File", "f1"): {}, ("File", "f2"): {}, ("Dev", "d1"): {}}
    assert ingest.all_edges(df.limit(0), edges).collect() == []


def test_union_first_wins_and_reconcile(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {(r["k"], r["v"], r["source_no"]) for r in ingest.union_first_wins([a, b], "k").collect()} == {("x", 1, 0), ("y", 3, 1)}
    assert {tuple(r) for r in ingest.reconcile(a, b, "k", "v").collect()} == {("x", 1, 2, False), ("y", 0, 3, False)}


def test_tiers_by_hand(spark):
    hubs = spark.createDataFrame([("c1", 0, 10, 1, "p/a"), ("c2", 1, 20, 0, "p/b"), ("c2", 1, 20, 0, "p/a")], "id string, seq long, ts long, y int, hub string")
    edges = spark.createDataFrame([("p/x", "p/a"), ("p/a", "q/y"), ("q/y", "q/z"), ("p/b", "p/a")], "src string, dst string")
    got = {}
    for r in tiers.import_tiers(hubs, edges).collect():
        got.setdefault((r["id"], r["tier"]), set()).add(r["other"])
    assert got["c1", "T1_dep"] == {"p/x", "p/b"} and got["c1", "T1_dry"] == {"q/y"} and got["c1", "T1"] == {"p/x", "p/b", "q/y"} and got["c1", "T2"] == {"q/z"}
    assert got["c2", "T1"] == {"p/x", "q/y"}
    more = hubs.unionByName(spark.createDataFrame([("c3", 2, 30, 0, "p/a")], hubs.schema))
    assert [tuple(r) for r in tiers.cochange_tier(more).where("id = 'c3'").collect()] == [("c3", "p/b")]
    assert tiers.cochange_tier(more).where("id = 'c1'").collect() == []


def test_cochange_does_not_depend_on_blocks(spark):
    rng = random.Random(4)
    rows = sorted({(f"e{i:02d}", i, i, 0, rng.choice(["hot", "hot", *"abcdef"])) for i in range(50) for _ in range(3)})
    hubs = spark.createDataFrame(rows, "id string, seq long, ts long, y int, hub string")
    want, counts = set(), {}
    for i in range(50):
        own = sorted({r[4] for r in rows if r[1] == i})
        for a in own:
            best = sorted(counts.get(a, {}).items(), key=lambda kv: (-kv[1], kv[0]))[:2]
            want |= {(f"e{i:02d}", b) for b, _ in best if b not in own}
        for a in own:
            for b in own:
                if a != b:
                    counts.setdefault(a, {})[b] = counts.get(a, {}).get(b, 0) + 1
    for block in (7, 50_000):
        assert {tuple(r) for r in tiers.cochange_tier(hubs, 2, block).collect()} == want


def test_ordinal_match_of_one_method(spark):
    """before a, a, b; after a, b, b: two kept, one removed, one added."""
    rows = lambda types: spark.createDataFrame([("m", t, i, t) for i, t in enumerate(types)], "method string, type string, node int, value string")
    out = dl.ordinal_match(rows("aab"), rows("abb"), ["method", "type"], ["node"]).collect()
    assert sorted(r["op"] for r in out) == ["ADDS", "KEEP", "KEEP", "REMOVES"]
    assert {(r["type"], r["delta"]) for r in dl.multiset_delta(rows("aab"), rows("abb"), ["type"]).collect()} == {("a", -1), ("b", 1)}
    assert all(r["op"] == "ADDS" for r in dl.ordinal_match(rows(""), rows("ab"), ["method", "type"], ["node"]).collect())


def tree(spark, rows):
    return spark.createDataFrame([("f", *r) for r in rows], "file string, node int, parent int, ast_type string, value string, place int")


def test_subtree_match(spark):
    before = [(0, None, "root", None, 0), (1, 0, "if", "x", 1), (2, 1, "call", "f", 2), (3, 0, "call", "g", 3)]
    after = [(10, None, "root", None, 0), (11, 10, "call", "new", 1), (12, 10, "if", "x", 2), (13, 12, "call", "f", 3), (14, 10, "call", "g", 4)]
    got = {(r["before_id"], r["after_id"]): r["how"] for r in dl.subtree_match(tree(spark, before), tree(spark, after)).collect()}
    assert got == {(0, 10): "place", (1, 12): "subtree", (2, 13): "subtree", (3, 14): "subtree", (None, 11): "inserted"}
    alone = dl.subtree_match(tree(spark, before), tree(spark, []).limit(0)).collect()
    assert {r["how"] for r in alone} == {"deleted"} and len(alone) == 4


def test_subtree_hash_depends_on_order_of_children():
    df = pd.DataFrame([(0, None, "r", None, 0), (1, 0, "a", None, 1), (2, 0, "b", None, 2)], columns=["node", "parent", "ast_type", "value", "place"])
    swapped = df.assign(place=[0, 2, 1])
    assert dl.subtree_hashes(df)[0] != dl.subtree_hashes(swapped)[0] and dl.subtree_hashes(df)[1] == dl.subtree_hashes(swapped)[1]


def test_line_graph(spark):
    got = dl.line_graph(spark.createDataFrame([("f", "a\n  b\n\n  c\nd"), ("g", None)], "file string, text string"), "file", "text").collect()
    assert [(r["node"], r["parent"], r["ast_type"]) for r in sorted(got, key=lambda r: r["place"])] == [(0, None, "a"), (1, 0, "b"), (3, 0, "c"), (4, None, "d")]


def test_reaching_definitions_through_a_loop(spark):
    edges = spark.createDataFrame([("m", a, b) for a, b in ((1, 2), (2, 3), (3, 2), (2, 4))], "k string, src int, dst int")
    defs = spark.createDataFrame([("m", 1, "x"), ("m", 3, "x")], "k string, node int, var string")
    got = {(r["node"], r["def_node"]) for r in dl.reaching_definitions(edges, defs, "k").collect()}
    assert got == {(2, 1), (2, 3), (3, 1), (3, 3), (4, 1), (4, 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Fix NullPointerException in fooBar.baz and my_var, 12abc the tokenset x",), (None,), ("",)], "m string")
    got = [[tuple(t) for t in r[0]] for r in df.select(tx.typed_tokens(F.col("m"))).collect()]
    assert ("error", "nullpointerexception") in got[0] and ("code", "foobar") in got[0] and ("code", "my_var") in got[0]
    assert ("bug", "fix") in got[0] and not any(t in ("the", "tokenset") for _, t in got[0])
    assert got[1] == [] and got[2] == []
    assert [r[0] for r in df.select(tx.intent(F.col("m"))).collect()] == ["fix", "other", "other"]
    assert spark.sql("SELECT 'ab\ncdef' AS t").select(*tx.line_and_column(F.col("t"), F.lit(5))).collect()[0][:] == (2, 2)
    assert spark.createDataFrame([(["a", "z", "b"],)], "t array<string>").select(tx.encode_ids(F.col("t"), F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(6)), 5)).collect()[0][0] == [5, 1, 6, 0, 0]
    assert spark.sql("SELECT 'XMLHttpRequest_fooBar' AS t").select(tx.camel_words(F.col("t"))).collect()[0][0] == ["xml", "http", "request", "foo", "bar"]
    diff = spark.createDataFrame([("--- a/x.java\n+++ b/y.java\n@@\n+new\n-old\n same",)], "d string")
    assert diff.select(tx.diff_lines(F.col("d"), "+"), tx.diff_lines(F.col("d"), "-"), tx.diff_paths(F.col("d"))).collect()[0][:] == ("new", "old", ["x.java", "y.java"])


def test_clock(spark):
    f = dates.clock_features(F.lit(1_704_067_200 + 3 * 3600))  # Monday, 3 in the morning
    r = spark.range(1).select(*[x.alias(n) for n, x in f.items()]).collect()[0]
    assert (r["wday_cos"], r["is_weekend"], r["is_latenight"]) == (1.0, 0, 1) and r["hour_sin"] == pytest.approx(2**0.5 / 2)


def test_textrank_and_npmi(spark):
    docs = spark.createDataFrame([("d1", ["a", "b", "a", "c"]), ("d2", ["solo"]), ("d3", []), ("d4", None)], "id string, ts array<string>")
    got = {(r["id"], r["term"]): r["centrality"] for r in tg.textrank(docs, "id", "ts", iterations=40).collect()}
    assert got["d2", "solo"] == 1.0 and set(got) == {("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "solo")}
    assert sum(v for (i, _), v in got.items() if i == "d1") == pytest.approx(1) and got["d1", "a"] > got["d1", "b"]
    terms = spark.createDataFrame([(i, t, 0, i % 2) for i in range(8) for t in (["p", "q"] if i < 3 else ["r"])], "id long, term string, seq int, y int")
    assert {(r["a"], r["b"]) for r in tg.npmi_edges(terms, 8).collect()} == {("p", "q"), ("q", "p")}
    base = spark.createDataFrame([("p", 1.0), ("q", 0.0), ("r", 0.5)], "term string, base double")
    risk = {r["term"]: r["risk"] for r in tg.propagate(base, tg.npmi_edges(terms, 8), 1, 0.5).collect()}
    assert risk == {"p": 0.5, "q": 0.5, "r": 0.5}


def test_prequential_never_sees_the_block(spark):
    rng = random.Random(1)
    rows = [(f"e{i}", i, i % 2, float(i % 2) + rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, seq long, y int, x double")
    a = ml.prequential(df, lambda: ml.scaled(["x"], ml.logistic(0.01)), 40, 40)
    b = ml.prequential(df.withColumn("y", F.when(F.col("seq") >= 80, 1 - F.col("y")).otherwise(F.col("y"))), lambda: ml.scaled(["x"], ml.logistic(0.01)), 40, 40)
    sa, sb = ({r["seq"]: r["score"] for r in d.collect()} for d in (a, b))
    assert len(sa) == 80 and sa == pytest.approx(sb)
    assert ml.prequential(df.limit(0), lambda: ml.scaled(["x"], ml.logistic()), 0).collect() == []
    assert {r["score"] for r in ml.prequential(df.withColumn("y", F.lit(1)), lambda: ml.scaled(["x"], ml.logistic()), 100, 10).collect()} == {1.0}


def test_stream_state_equals_batch_and_late_rows_drop(spark, tmp_path):
    rows = [(i, f"u{i % 3}", i % 2, f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, u string, y int, t string").withColumn("ts", F.to_timestamp("t"))
    for i in range(4):
        df.where(f"id div 10 = {i}").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    (tmp_path / "events.parquet").mkdir()
    for i in range(4):
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(tmp_path / f"events.parquet/{i}.parquet")
        import os

        os.utime(tmp_path / f"events.parquet/{i}.parquet", (1000 + i, 1000 + i))
    s = st.read_table_stream(spark, str(tmp_path), "events", 1)
    got = {r["id"]: (r["past_n"], r["past_bad"]) for r in st.drain(st.past_rates(s, "u", ["ts", "id"], "y", "id")).collect()}
    assert got == {i: (i // 3, sum(j % 2 for j in range(i % 3, i, 3))) for i in range(40)}
    closed = st.drain(st.tumbling_counts(s.withWatermark("ts", "1 minute"), "ts", "10 minutes", []))
    assert sum(r["n"] for r in closed.collect()) == 30
    query = st.upsert_batches(s.select("u", "id", "y"), str(tmp_path / "table"), "u", "id", str(tmp_path / "ckpt"))
    query.awaitTermination()
    assert {(r["u"], r["id"]) for r in st.newest_version(spark, str(tmp_path / "table")).collect()} == {("u0", 39), ("u1", 37), ("u2", 38)}
