import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import past

SCHEMA = "id string, seq long, y int, actor string, block_ int, past_n_ string"


def stream(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(f"e{i}", i, rng.randrange(2), rng.choice(["hot", "hot", "b", None]), 0, "clash") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_sums_over_the_strict_past_do_not_depend_on_blocks(spark, block):
    rows, df = stream(spark)
    got = past.strict_past(df, ["actor"], "seq", {"n": ("sum", F.lit(1)), "bad": ("sum", F.col("y")), "last": ("max", F.col("seq"))}, block).collect()
    for r in got:
        before = [x for x in rows if x[3] == r["actor"] and x[1] < r["seq"]]
        assert (r["n"], r["bad"], r["last"]) == (len(before), sum(x[2] for x in before), max((x[1] for x in before), default=None))
    assert len(got) == 120


@pytest.mark.parametrize("k,block", [(5, 6), (50, 7), (3, 1 << 20)])
def test_recent_rows(spark, k, block):
    rows, df = stream(spark)
    got = past.recent_past(df, "seq", k, {"s": F.sum("y")}, block_rows=block).collect()
    assert {r["seq"]: r["s"] or 0 for r in got} == {i: sum(x[2] for x in rows[max(0, i - k) : i]) for i in range(120)}
    incl = past.recent_past(df, "seq", k, {"s": F.sum("y")}, inclusive=True, block_rows=block).collect()
    assert {r["seq"]: r["s"] for r in incl} == {i: sum(x[2] for x in rows[max(0, i - k + 1) : i + 1]) for i in range(120)}


def test_a_later_label_changes_nothing_before_it(spark):
    rows, df = stream(spark)
    flipped = df.withColumn("y", F.when(F.col("seq") >= 60, 1 - F.col("y")).otherwise(F.col("y")))
    feats = lambda d: {r["id"]: tuple(r) for r in past.with_actor_prior(past.with_global_prior(d)).where("seq <= 60").select("id", "past_n", "past_bad", "actor_n", "actor_bad", "actor_rate").collect()}
    assert feats(df) == feats(flipped)


def test_sequence_of_ties_nulls_and_any_partitioning(spark):
    rows = [(i % 5 if i % 7 else None, f"id{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "ts int, id string")
    want = {id_: n for n, (_, id_) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for d in (df, df.repartition(13), df.orderBy(F.desc("id")).coalesce(1)):
        assert {r["id"]: r["seq"] for r in past.with_sequence(d, ["ts", "id"]).collect()} == want
    assert past.with_sequence(df.limit(0), ["ts", "id"]).collect() == []


def test_hand_computed_priors(spark):
    """Two actors, labels 1 0 1 1 0 0."""
    rows = [("a", 0, 1, "x", 0, ""), ("b", 1, 0, "x", 0, ""), ("c", 2, 1, "y", 0, ""), ("d", 3, 1, "x", 0, ""), ("e", 4, 0, "y", 0, ""), ("f", 5, 0, "x", 0, "")]
    got = past.with_actor_prior(past.with_global_prior(spark.createDataFrame(rows, SCHEMA))).orderBy("seq").collect()
    g = [0, 1, 0.5, 2 / 3, 0.75, 0.6]
    assert [r["global_rate"] for r in got] == pytest.approx(g)
    assert [r["actor_rate"] for r in got] == pytest.approx([0, (1 + 5) / 6, 0.5, (1 + 5 * g[3]) / 7, (1 + 5 * g[4]) / 6, (2 + 5 * g[5]) / 8])


def test_events_without_hubs(spark):
    ev = past.with_global_prior(spark.createDataFrame([("a", 0, 1, "x", 0, ""), ("b", 1, 0, "x", 0, "")], SCHEMA))
    hubs = spark.createDataFrame([("a", 0, 1, "h")], "id string, seq long, y int, hub string")
    got = {r["id"]: (r["hub_mean"], r["hub_max"], r["max_churn"]) for r in past.hub_prior(hubs, ev).collect()}
    assert got == {"a": (0.0, 0.0, 0), "b": (1.0, 1.0, 0)}
