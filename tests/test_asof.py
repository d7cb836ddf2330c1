import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import Events, Statements, known_at_event_time, seconds

EV = Events("who", "at", ("id",))
ST = Statements("who", "valid_from", "known_at", "rev", ("rev", "value"))
EV_SCHEMA = "id long, who string, at long, value string, e string"
ST_SCHEMA = "who string, valid_from long, known_at long, rev long, value string, t long"


def brute(events, said):
    out = {}
    for id_, who, at, *_ in events:
        ok = [s for s in said if who is not None and at is not None and s[0] == who and None not in s[1:3] and s[1] <= at and s[2] <= at]
        best = max(ok, key=lambda s: (s[1], s[2], -1 if s[3] is None else s[3]), default=None)
        out[id_] = (best[3], best[4]) if best else (None, None)
    return out


@pytest.mark.parametrize("rows_per_bucket", [500_000, 20])
def test_against_brute_force_with_a_hot_entity(spark, rows_per_bucket):
    rng = random.Random(7)
    who = lambda: rng.choice(["hot", "hot", "hot", *"abcdefgh", None])
    said = [(who(), rng.choice([None, *range(60)]), rng.choice([None, *range(60)]), i, rng.choice(["x", "y", None]), 0) for i in range(400)]
    said += said[:40]
    events = [(i, who(), rng.choice([None, *range(-5, 70)]), "clash", "e") for i in range(300)]
    events += [(1000 + i, "hot", 30, "clash", "e") for i in range(100)] + events[:30]
    got = known_at_event_time(
        spark.createDataFrame(events, EV_SCHEMA), spark.createDataFrame(said, ST_SCHEMA), EV, ST, rows_per_bucket
    ).collect()
    assert len(got) == 400
    assert {r["id"]: (r["rev"], r["value"]) for r in got} == brute(events, said)


def test_never_uses_what_became_known_later(spark):
    said = [("a", 1, 100, 1, "late", 0), ("a", 0, 0, 0, "early", 0)]
    got = known_at_event_time(spark.createDataFrame([(1, "a", 50, "", "")], EV_SCHEMA), spark.createDataFrame(said, ST_SCHEMA), EV, ST)
    assert got.collect()[0]["value"] == "early"


def test_empty_tables(spark):
    none_e, none_s = spark.createDataFrame([], EV_SCHEMA), spark.createDataFrame([], ST_SCHEMA)
    assert known_at_event_time(none_e, none_s, EV, ST).collect() == []
    one = spark.createDataFrame([(1, "a", 5, "", "")], EV_SCHEMA)
    assert [tuple(r) for r in known_at_event_time(one, none_s, EV, ST).collect()] == [(1, None, None)]


def test_milliseconds(spark):
    df = spark.createDataFrame([(1_700_000_000_000,), (1_700_000_000,), (None,)], "t long")
    assert [r[0] for r in df.select(seconds("t")).collect()] == [1_700_000_000, 1_700_000_000, None]
    assert df.select(F.max(seconds("t"))).dtypes[0][1] == "bigint"


def test_payload_named_like_a_key(spark):
    events = spark.createDataFrame([(1, "a", 5, "own", "")], EV_SCHEMA)
    said = spark.createDataFrame([("a", 0, 0, 1, "known", 0)], ST_SCHEMA)
    got = known_at_event_time(events, said, Events("who", "at", ("id", "value")), ST).collect()[0]
    assert (got["value"], got["value_known"]) == ("own", "known")


def test_an_entity_of_many_more_rows_than_a_bucket(spark):
    """A third of 120,000 statements and of the events belong to one entity, others are large or small."""
    n = 120_000
    who = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, "warm").otherwise(F.concat(F.lit("e"), F.col("id") % 5000))
    said = spark.range(n).select(who.alias("who"), (F.col("id") * 7919 % 10_007).alias("valid_from"), (F.col("id") * 104_729 % 10_009).alias("known_at"), F.col("id").alias("rev"), F.lit("v").alias("value"))
    events = spark.range(1500).select("id", who.alias("who"), (F.col("id") * 613 % 11_000).alias("at"), F.lit("c").alias("value"))
    got = known_at_event_time(events, said, EV, ST, 5_000)
    j = events.alias("x").join(said.alias("y"), F.expr("x.who = y.who AND y.valid_from <= x.at AND y.known_at <= x.at"), "left")
    want = j.groupBy("x.id").agg(F.max(F.struct("y.valid_from", "y.known_at", "y.rev")).getField("rev").alias("want"))
    assert got.join(want, "id").where(~F.col("rev").eqNullSafe(F.col("want"))).count() == 0 and got.count() == 1500
