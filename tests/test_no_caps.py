"""Results go on beyond every former limit: chains, cores, columns, nesting, long lists."""

import numpy as np
import pytest

from tidemark.operators import builders, delta, graph, textgraph
from tidemark.streaming.events import drain


def test_definitions_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([("k", i, i + 1) for i in range(70)], "key string, src int, dst int")
    defs = spark.createDataFrame([("k", 0, "x")], "key string, node int, var string")
    assert delta.reaching_definitions(edges, defs, "key").count() == 70


def test_cores_of_a_clique_with_a_tail(spark):
    n = 40
    edges = [(f"c{i:02}", f"c{j:02}") for i in range(n) for j in range(i)] + [("c00", "t0"), ("t0", "t1"), ("s", "s")]
    got = {r["node"]: r["core"] for r in graph.kcore(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{f"c{i:02}": n - 1 for i in range(n)}, "t0": 1, "t1": 1, "s": 0}


def test_columns_beyond_the_fit_count(spark):
    """Two blocks of rows over columns of which the fit has a part: rows of one block stay alike, no row is lost."""
    cells = [(f"r{i:02}", f"{'ab'[i % 2]}{(i * 7 + k) % 20:02}", 1.0) for i in range(40) for k in range(17)]
    df = spark.createDataFrame(cells, "id string, hub string, m double").distinct()
    whole = {r["id"]: np.array(r["embedding"]) for r in graph.factor_embedding(df, 2).collect()}
    part = {r["id"]: np.array(r["embedding"]) for r in graph.factor_embedding(df, 2, fit_columns=12).collect()}
    assert set(whole) == set(part) and len(part) == 40
    alike = lambda e, a, b: abs(e[a] @ e[b]) / (np.linalg.norm(e[a]) * np.linalg.norm(e[b]) + 1e-12)
    assert min(alike(part, f"r{i:02}", f"r{i + 2:02}") for i in range(0, 38, 2)) > 0.5
    assert max(alike(part, f"r{i:02}", f"r{i + 1:02}") for i in range(0, 38, 2)) < 0.5


def test_deep_nesting_and_long_values(spark):
    depth = 400
    code = "class A { void m() {" + "if (a) {" * depth + "x = " + " + ".join(["verylongname"] * 40) + ";" + "}" * depth + "} }"
    rows = builders.build_graphs(spark.createDataFrame([("f", code)], "file string, text string"), layers=("ast",)).where("row = 'node'").collect()
    assert sum(r["type"] == "if" for r in rows) == depth
    assert max(len(r["value"]) for r in rows) > 400


def test_pairs_of_a_long_list(spark):
    rows = [("d", f"w{i:03}") for i in range(150)]
    assert textgraph.pair_counts(spark.createDataFrame(rows, "id string, term string")).count() == 150 * 149 // 2


def test_stream_without_batches_and_a_broken_folder(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert drain(stream).collect() == []
    import tidemark.streaming.events as events

    def broken(*_):
        raise OSError("gone")

    monkeypatch.setattr(events, "_exists", broken)
    with pytest.raises(OSError):
        drain(spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
