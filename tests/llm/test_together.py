import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tidemark.llm import together
from tidemark.llm.together import pairs_together

SCHEMA = "id long, items array<string>, term string, heavy int"


def brute(rows, least, least_together):
    sets = [{x for x in items or [] if x is not None} for _, items, *_ in rows]
    df = Counter(x for s in sets for x in s)
    pairs = Counter(p for s in sets for p in combinations(sorted(x for x in s if df[x] >= least), 2))
    n = len(rows)
    out = {}
    for (a, b), c in pairs.items():
        if c >= least_together:
            score = 1.0 if c == n else math.log(c * n / (df[a] * df[b])) / -math.log(c / n)
            out[a, b] = (df[a], df[b], c, pytest.approx(c * n / df[a] / df[b]), pytest.approx(score))
    return out


@pytest.mark.parametrize("heavy_share,looked_up,block", [(32, 50_000, 4_000_000), (4, 20, 40), (32, 3, 5), (1, 50_000, 9), (1000, 30, 7)])
def test_against_brute_force(spark, monkeypatch, heavy_share, looked_up, block):
    """Also where every item is heavy or none, and where most names are joined rather than looked up."""
    monkeypatch.setattr(together, "PAIR_BLOCK", block)
    monkeypatch.setattr(together, "BIT_BLOCK", 7)
    monkeypatch.setattr(together, "BIT_ROOM", 10 * block)
    rng = random.Random(heavy_share)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, [w for j, w in enumerate(words) if rng.random() < 2.5 / (j + 2)] * rng.choice([1, 2]), "t", 1) for i in range(150)]
    rows += [(900, None, "t", 1), (901, [], "t", 1), (902, [None, "w1", None, "w2"], "t", 1), (903, ["w0"], "t", 1)]
    got = pairs_together(spark.createDataFrame(rows, SCHEMA), "id", "items", 3, 2, heavy_share, looked_up).collect()
    assert {(r["term_a"], r["term_b"]): (r["df_a"], r["df_b"], r["together"], r["lift"], r["npmi"]) for r in got} == brute(rows, 3, 2)


def test_pair_in_every_record_and_empty(spark):
    rows = [(i, ["a", "b"], "t", 1) for i in range(4)]
    assert [(r["npmi"], r["lift"]) for r in pairs_together(spark.createDataFrame(rows, SCHEMA), "id", "items").collect()] == [(1.0, 1.0)]
    assert pairs_together(spark.createDataFrame([], SCHEMA), "id", "items").collect() == []


def test_hot_light_item_and_long_record(spark):
    """An item just under 1/32 of the records, one in nearly all, and a record of 300 items."""
    rows = [(i, ["all", *(["warm"] if i % 34 == 0 else []), f"x{i % 7}"], "t", 1) for i in range(680)] + [(1000, [f"y{j:03d}" for j in range(300)], "t", 1)]
    for looked_up in (2, 50_000):
        got = pairs_together(spark.createDataFrame(rows, SCHEMA), "id", "items", 1, 1, looked_up=looked_up).collect()
        assert {(r["term_a"], r["term_b"]): (r["df_a"], r["df_b"], r["together"], r["lift"], r["npmi"]) for r in got} == brute(rows, 1, 1)
