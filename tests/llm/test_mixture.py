import math
import os
import random

import pytest

from tidemark.llm.mixture import TOKENIZER, _encoding, mix, source_name, solve, token_counts, with_rates

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
DOCS = "doc_id long, text string, source string, lang string, n_tokens string, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = ["big"] * 6 + ["Mid ", "mid"] + ["small-one"]
        text = " ".join(rng.choice(["alpha", "beta", "naïve", "x_1"]) for _ in range(rng.randrange(1, 80)))
        rows.append((i, text, rng.choice(source), rng.choice(["en", "de"]), "clash", 1))
    rows += [(2000, None, "big", "en", "", 0), (2001, "", "mid", "en", "", 0), (2002, "some text", None, "en", "", 0), (2003, "some text", "unlisted", "en", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("SMALL_ONE", 0.2, 4), ("absent", 0.1, 9), (None, 0.5, 1)], TARGETS)
    mixed, report = mix(corpus(spark), targets)
    by = {r["source"]: r for r in report.collect()}
    whole = 1.0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small_one", 0.2)):
        assert by[s]["reached_share"] == pytest.approx(share / whole, abs=0.01)
        assert by[s]["most_copies"] <= by[s]["max_repeats"]
        assert by[s]["reached_tokens"] == pytest.approx(by[s]["wanted_tokens"], rel=0.02)
    assert by["absent"]["reached_share"] == 0 and by["absent"]["wanted_tokens"] is None
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 902
    assert all(r["copies"] == 0 for r in rows if r["n_tokens"] == 0)
    again, _ = mix(corpus(spark).repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("per_token", [False, True])
def test_multipliers_meet_margins(spark, per_token):
    counted = token_counts(corpus(spark), ["doc_id", "source", "lang"], "text").withColumn("source", source_name("source"))
    plan = solve(counted, [("big", 0.6, 2), ("mid", 0.4, 3)], {"lang": {"en": 0.7, "de": 0.3}}, 6000, per_token)
    got = {"big": 0.0, "mid": 0.0, "en": 0.0, "de": 0.0}
    for r in counted.where("source IN ('big', 'mid')").collect():
        e = plan.multipliers["source", r["source"]] + plan.multipliers["lang", r["lang"]]
        rate = min(plan.cap[r["source"]], math.exp(e if per_token else e * r["n_tokens"]))
        got[r["source"]] += rate * r["n_tokens"]
        got[r["lang"]] += rate * r["n_tokens"]
    assert got == pytest.approx({"big": 3600, "mid": 2400, "en": 4200, "de": 1800}, rel=1e-6)
    assert 0 < plan.iterations < 60 and plan.gradient <= 1e-9


def test_rates_have_the_least_entropy(spark):
    """No other rates with the same tokens are nearer to one copy each."""
    counted = spark.createDataFrame([(i, "s", n) for i, n in enumerate([1, 2, 3, 5, 8, 40])], "doc_id long, source string, n_tokens long")
    plan = solve(counted, [("s", 1.0, 3)], total_tokens=90)
    rates = {r["doc_id"]: (r["n_tokens"], r["rate"]) for r in with_rates(counted, plan).collect()}
    entropy = lambda rs: sum(r * math.log(r) - r for r in rs if r > 0)
    own = [rates[i][1] for i in range(6)]
    assert sum(n * r for n, r in rates.values()) == pytest.approx(90) and max(own) <= 3 * (1 + 1e-12)
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.sample(range(6), 2)
        move = rng.uniform(-1, 1)
        other = list(own)
        other[a] += move / rates[a][0]
        other[b] -= move / rates[b][0]
        if min(other) >= 0 and max(other) <= 3:
            assert entropy(other) >= entropy(own) - 1e-6


def test_what_cannot_be_met_raises(spark):
    counted = spark.createDataFrame([(i, "s", 10, "ab"[i % 2]) for i in range(20)], "doc_id long, source string, n_tokens long, lang string")
    with pytest.raises(ValueError, match="200 at most"):
        solve(counted, [("s", 1.0, 1)], total_tokens=1000)
    with pytest.raises(ValueError, match="lang = a"):
        solve(counted, [("s", 1.0, 1)], {"lang": {"a": 0.9, "b": 0.1}}, total_tokens=150)


def test_very_many_sources(spark):
    n = 4000
    docs = spark.range(2 * n).selectExpr("id AS doc_id", "'some words of text' AS text", "concat('s', id % 4000) AS source")
    targets = spark.range(n).selectExpr("concat('s', id) AS source", "1.0D AS target_share", "2 AS max_repeats")
    mixed, report = mix(docs, targets)
    assert mixed.count() == 2 * n and {r["copies"] for r in mixed.collect()} == {2}
    assert report.where("reached_tokens = wanted_tokens").count() == n


def test_a_source_that_is_used_up(spark):
    """The default total uses every document of one source as often as it may be, the shortest too."""
    mixed, report = mix(corpus(spark), spark.createDataFrame([("small_one", 0.9, 5), ("big", 0.1, 1)], TARGETS))
    rows = [r for r in mixed.collect() if r["source"] == "small_one" and r["n_tokens"]]
    assert {r["copies"] for r in rows} == {5}


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["Hello, world!\n\n  x = 1", "", None, "été 日本語 <|endoftext|>", "word " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, ["doc_id"], "text").collect()}
    assert got == {i: len(_encoding(TOKENIZER).encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_empty(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    mixed, report = mix(none, targets)
    assert mixed.collect() == [] and [r["reached_share"] for r in report.collect()] == [0.0]
    mixed, report = mix(corpus(spark), targets.where("source = 'x'"))
    assert mixed.collect() == [] and report.collect() == []
