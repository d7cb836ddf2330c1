import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import stats

SCHEMA = "id string, seq long, y int, s double, t double, effort double"


def data(n=200, seed=1):
    rng = random.Random(seed)
    return [(f"e{i:04d}", i, int(rng.random() < 0.3), round(rng.random(), 1), round(rng.random(), 2), float(rng.choice([0, 1, 5, 5, 40]))) for i in range(n)]


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_ties_give_midranks(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.2)], "y int, s double")
    assert ev.roc_auc(df, "s", "y").collect()[0]["auc"] == 0.75
    assert ev.roc_auc(df.where("y = 1"), "s", "y").collect()[0]["auc"] is None
    assert ev.roc_auc(df.limit(0), "s", "y").collect()[0]["auc"] is None


def test_ranking_metrics(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    y, s = [r[2] for r in rows], [r[3] for r in rows]
    assert ev.roc_auc(df, "s", "y").collect()[0]["auc"] == pytest.approx(auc(y, s))
    cuts = sorted(set(s), reverse=True)
    ap, before = 0.0, 0
    f1 = []
    for c in cuts:
        tp, pp = sum(a for a, b in zip(y, s) if b >= c), sum(b >= c for b in s)
        ap += (tp - before) / sum(y) * tp / pp
        before = tp
        f1.append((2 * tp / (pp + sum(y)), c))
    assert ev.average_precision(df, "s", "y").collect()[0][0] == pytest.approx(ap)
    got = ev.best_f1(df, "s", "y").collect()[0]
    assert (got["f1"], got["threshold"]) == pytest.approx(max(f1))
    assert ev.best_f1(df.where("y = 0"), "s", "y").collect()[0]["threshold"] == 0.5


def test_online_decisions(spark):
    rows = data(230)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    thr, want = 0.5, []
    for i in range(len(y)):
        want.append(int(p[i] >= thr))
        if i + 1 >= 60 and (i + 1) % 20 == 0:
            hi = i + 1 - 7
            cuts = sorted(set(p[:hi]))
            thr = max(((2 * y[:hi][p[:hi] >= c].sum() / ((p[:hi] >= c).sum() + y[:hi].sum())), c) for c in cuts)[1]
    got = ev.online_decisions(spark.createDataFrame(rows, SCHEMA), "seq", "s", "y", 60, 20, 7).orderBy("seq").collect()
    assert [r["decision"] for r in got] == want
    assert ev.online_decisions(spark.createDataFrame([], SCHEMA), "seq", "s", "y").collect() == []


def test_effort_extremes(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", i, int(rng.random() < 0.3), 0.0, 0.0, float(rng.randrange(0, 50))) for i in range(400)]
    def at(score):
        scored = [(a, b, c, score(c, max(e, 1.0)), 0.0, e) for a, b, c, _, _, e in rows]
        return ev.popt(spark.createDataFrame(scored, SCHEMA), "y", "s", "effort", "id").collect()[0]["popt"]

    assert at(lambda y, e: (y * 1e6 + 1 / e) * e) == pytest.approx(1.0)
    assert at(lambda y, e: (-y * 1e6 + e) * e) == pytest.approx(0.0, abs=1e-9)
    assert 0.2 < at(lambda y, e: rng.random() * e) < 0.8
    points = ev.effort_points(spark.createDataFrame([("a", 0, 1, 9.0, 0.0, 100.0), ("b", 1, 0, 0.0, 0.0, 1.0)], SCHEMA), "y", "s", "effort", "id").collect()[0]
    assert points["acc_at"] == 1.0  # the first row always counts


def test_macro_and_weighted(spark):
    df = spark.createDataFrame([("A", 0.4, 100), ("B", 0.8, 200), ("C", None, 5), ("D", float("nan"), 5)], "p string, v double, n int")
    r = ev.combine(df, [], "v", ["n"]).collect()[0]
    assert (r["macro"], r["weighted_n"], r["n"]) == (pytest.approx(0.6), pytest.approx(2 / 3), 2)


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 9) for r in stats.holm(df, "p", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_describe(spark):
    xs = [5.0, 1.0, 1.0, 9.0, 4.0]
    r = stats.describe(spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double"), "x").collect()[0]
    a = np.sort(xs)
    gini = 2 * (np.arange(1, 6) * a).sum() / (5 * a.sum()) - 6 / 5
    want = [5, a.mean(), a.std(), 1, np.percentile(a, 50), np.percentile(a, 95), 9, 20, gini, ((a - a.mean()) ** 3).mean() / a.std() ** 3]
    assert list(r) == pytest.approx(want)
    assert list(stats.describe(spark.createDataFrame([], "x double"), "x").collect()[0] if stats.describe(spark.createDataFrame([], "x double"), "x").count() else [0]) [0] == 0
    assert stats.describe(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect()[0]["skew"] == 0


def test_delong_against_definition(spark):
    rows = data(80, 4)
    y = np.array([r[2] for r in rows])
    comps = []
    for k in (3, 4):
        p = np.array([r[k] for r in rows])
        psi = (p[y == 1][:, None] > p[y == 0]).astype(float) + 0.5 * (p[y == 1][:, None] == p[y == 0])
        comps.append((psi.mean(1), psi.mean(0)))
    (a1, a0), (b1, b0) = comps
    var = np.var(a1 - b1, ddof=1) / len(a1) + np.var(a0 - b0, ddof=1) / len(a0)
    r = stats.delong(spark.createDataFrame(rows, SCHEMA), "y", "s", "t").collect()[0]
    z = (a1.mean() - b1.mean()) / math.sqrt(var)
    assert (r["auc_a"], r["auc_b"], r["z"]) == pytest.approx((a1.mean(), b1.mean(), z))
    assert r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_normal_cdf(spark):
    xs = [-4.0, -1.0, 0.0, 0.5, 3.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-7)


def test_bootstrap_weights_have_mean_one(spark):
    df = spark.range(20000).select(stats.poisson_one(stats.unit_hash("id")).alias("w"))
    r = df.agg(F.avg("w"), F.var_pop("w")).collect()[0]
    assert r[0] == pytest.approx(1, abs=0.03) and r[1] == pytest.approx(1, abs=0.06)


def test_init_window_and_scrub(spark):
    df = spark.createDataFrame([(i, int(i in (5, 40, 41, 42))) for i in range(60)], "seq long, y int")
    assert ev.init_window(df, "seq", "y", 0, 10, 60, 5, 3) == 45
    assert ev.init_window(df, "seq", "y", 0, 10, 30, 5, 3) == 30
    s = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.3,)], "s double").select(ev.scrub(F.col("s")))
    assert [r[0] for r in s.collect()] == [0.5, 0.5, 1.0, 0.0, 0.3]
