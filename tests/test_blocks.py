"""Blocks computed in tasks from numbers against joined frames."""

import os
import random

import pytest

from tests.parity import FOLDER
from tests.test_online import frame, stream
from tidemark.operators import blocks, graph, online, textgraph
from tidemark.plans import model_queries

N = 90
LARGER = os.path.join(os.path.dirname(FOLDER), "sf0.01")  # the smallest have no scored events after the windows


@pytest.mark.parametrize("first,steps,at_once", [(6, 8, 1_000_000), (0, 5, 7), (6, 1, 1_000_000)])
def test_graph_scores_equal_joins(spark, monkeypatch, first, steps, at_once):
    """Three graphs with frequent and rare hubs, events without hubs, a first block with and without a past."""
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    monkeypatch.setattr(blocks, "EVENTS", 16)
    rng, starts = random.Random(first), list(range(first, N, 20))
    ev = spark.createDataFrame([(f"e{i:02}", i, rng.randrange(3) // 2) for i in range(N)], "id string, seq long, y int")
    cells = lambda tag, hubs: sorted({(rng.randrange(N), f"{tag}{min(rng.randrange(hubs), rng.randrange(hubs))}") for _ in range(150)})
    own = {k: spark.createDataFrame([(s, h, float(rng.randrange(1, 4))) for s, h in cells(k, n)], "seq long, hub string, tf double") for k, n in (("a", 60), ("b", 4))}
    got = {r["seq"]: r for r in blocks.graph_blocks(ev, own, N, starts, 20, steps).collect()}
    assert sorted(got) == list(range(first, N))
    for name, rows in (*own.items(), ("full", own["a"].unionByName(own["b"]))):
        inc = graph.incidence(rows.join(ev, "seq"), N, weight="tf")
        for kind, found in (
            ("rn", graph.rn_scores(inc, ev, 20, first).where(f"seq >= {first}")), ("lp", graph.propagation_blocks(inc, ev, starts, 20)), ("ppr", graph.ppr_blocks(inc, ev, starts, 20, iterations=steps)),
        ):
            assert {s: r[f"{name}_{kind}"] for s, r in got.items()} == pytest.approx({r["seq"]: r[2] if kind != "ppr" else r["score"] for r in found.collect()})


@pytest.mark.parametrize("first", [0, 7])
def test_text_prior_equals_joins(spark, monkeypatch, first):
    rng = random.Random(first)
    ev = spark.createDataFrame([(f"e{i:02}", i, rng.randrange(2)) for i in range(N)], "id string, seq long, y int")
    rows = sorted({(rng.randrange(N), f"w{rng.randrange(4) + rng.randrange(8)}") for _ in range(300)})
    terms = spark.createDataFrame(rows, "seq long, term string").join(ev, "seq")
    run = lambda: {r["id"]: r["prior"] for r in textgraph.online_prior(terms, ev, list(range(first, N, 11)), 11, least_npmi=0.05).collect()}
    monkeypatch.setattr(blocks, "AT_ONCE", 20)
    got = run()
    monkeypatch.setattr(blocks, "ROWS", 0)
    assert len(got) == N - (first or 11) and len(set(got.values())) > N / 2 and got == pytest.approx(run())


@pytest.mark.parametrize("l1,many", [(False, 1), (False, 8), (True, 8)])
def test_models_of_tasks_equal_those_of_passes(spark, monkeypatch, l1, many):
    monkeypatch.setattr(online, "MANY", many)
    df = frame(spark, *stream(200, 3, 5))
    run = lambda: {(r["combo"], r["seq"]): r["score"] for r in online.prequential_linear(df, ["a", "b", "c"], 10, 40, 5, l1=l1, subsets={"ab": ["a", "b"], "c": ["c"], "abc": ["a", "b", "c"]}).collect()}
    got = run()
    monkeypatch.setattr(online, "CELLS", 0)
    assert got == pytest.approx(run(), abs=1e-6)


def test_models_are_fitted_without_a_pass_a_step(spark, monkeypatch):
    monkeypatch.setattr(online, "_derivatives", None)
    assert len({r["score"] for r in online.prequential_linear(frame(spark, *stream()), ["a", "b", "c"], 40, 50).collect()}) > 200


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name,rows", [("fusion_search", 39), ("fusion_ablation", 63)])
def test_fusions_without_joined_walks(spark, monkeypatch, name, rows):
    monkeypatch.setattr(model_queries.graph, "walk", None)
    monkeypatch.setattr(model_queries.graph, "propagation_blocks", None)
    assert model_queries.QUERIES[name](spark, LARGER).count() == rows
