import numpy as np
import pytest

from tidemark.operators.online import prequential_linear


def stream(n=260, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1] + [0, 3, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(f"e{i}", i, int(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id string, seq long, y int, a double, b double, c double").repartition(5)


def optimum(theta, z, y, w, inverse, l1):
    """How far theta is from fulfilling the conditions of the optimum."""
    p = 1 / (1 + np.exp(-(z @ theta)))
    g = inverse * z.T @ ((p - y) * w)
    if not l1:
        return np.abs(g + np.r_[0, theta[1:]]).max()
    free = np.abs(theta) > 1e-9
    free[0] = True
    off = np.abs(g + np.r_[0, np.sign(theta[1:])])[free].max()
    return max(off, (np.abs(g[~free]) - 1).max() if (~free).any() else 0)


def weights_from(scores, x, rows):
    """Raw weights by solving the logits of the block's rows."""
    logit = np.log(scores / (1 - scores))
    return np.linalg.lstsq(np.c_[np.ones(len(rows)), x[rows]], logit, rcond=None)[0]


@pytest.mark.parametrize("l1,inverse,gap", [(False, 1.0, 0), (False, 0.05, 10), (True, 0.2, 10)])
def test_every_block_is_at_the_optimum_of_its_past(spark, l1, inverse, gap):
    x, y = stream()
    got = {r["seq"]: r["score"] for r in prequential_linear(frame(spark, x, y), ["a", "b", "c"], 40, 50, gap, 1, inverse, l1).collect()}
    assert sorted(got) == list(range(40, 260))
    for start in range(40, 260, 50):
        rows = np.arange(start, min(start + 50, 260))
        raw = weights_from(np.array([got[i] for i in rows]), x, rows)
        px, py = x[: start - gap], y[: start - gap]
        mean, sd = px.mean(0), px.std(0)
        theta = np.r_[raw[0] + raw[1:] @ mean, raw[1:] * sd]
        theta[np.abs(theta) < 1e-7] = 0
        w = np.where(py == 1, len(py) / 2 / py.sum(), len(py) / 2 / (len(py) - py.sum()))
        assert optimum(theta, np.c_[np.ones(len(px)), (px - mean) / sd], py, w, inverse, l1) < 1e-3


def test_subsets_equal_runs_of_their_own(spark):
    x, y = stream(160, 3, 2)
    df = frame(spark, x, y)
    both = prequential_linear(df, ["a", "b", "c"], 30, 60, subsets={"ab": ["a", "b"], "c": ["c"]}).collect()
    for name, columns in (("ab", ["a", "b"]), ("c", ["c"])):
        own = {r["seq"]: r["score"] for r in prequential_linear(df, columns, 30, 60).collect()}
        assert {r["seq"]: r["score"] for r in both if r["combo"] == name} == pytest.approx(own, abs=1e-6)


def test_one_class_gap_and_empty(spark):
    x, y = stream(60, 3, 3)
    y[:25] = 0
    y[25:30] = 1
    got = {r["seq"]: r["score"] for r in prequential_linear(frame(spark, x, y), ["a", "b", "c"], 20, 10, gap=8).collect()}
    assert [got[i] for i in range(20, 30)] == [0.0] * 10  # only zeros are known
    assert len(set(got[i] for i in range(30, 40))) == 10  # the window less the gap has one class, the one up to the block two
    assert prequential_linear(frame(spark, x[:0], y[:0]).where("seq < 0"), ["a"], 20, 10).collect() == []
