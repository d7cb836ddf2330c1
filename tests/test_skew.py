from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators.skew import aggregate_balanced, hot_keys, join_fragmented, join_salted, place, plan_load

SCHEMA = "k string, n long, task_ string"


def skewed(spark, rows=6000):
    """A third of all rows has one key; null is a key too."""
    data = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 997}", i % 400, "x") for i in range(rows)]
    return data, spark.createDataFrame(data, SCHEMA)


def test_tasks_get_even_loads(spark):
    _, df = skewed(spark)
    plan = plan_load(df, ["k"], 8)
    assert len(plan.named) <= 20 * 8
    assert len(dict(plan.named)[("hot",)]) >= 2
    sizes = [r["count"] for r in place(df, plan, "at").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.5 * 6000 / 8


def test_aggregate_equals_counter(spark):
    data, df = skewed(spark)
    got = aggregate_balanced(
        df, ["k"], {"c": F.count(F.lit(1)), "d": F.count_distinct("n")}, {"c": F.sum("c"), "d": F.sum("d")}, 8, ["n"]
    ).collect()
    assert {r["k"]: r["c"] for r in got} == Counter(k for k, *_ in data)
    assert {r["k"]: r["d"] for r in got} == {k: len(set(ns)) for k, ns in groups(data).items()}


def groups(data):
    out = {}
    for k, n, _ in data:
        out.setdefault(k, []).append(n)
    return out


def test_joins_equal_plain_joins(spark):
    _, df = skewed(spark, 900)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("nowhere", 5)], "k string, n long")
    for how in ("inner", "left"):
        want = Counter(map(tuple, df.join(right.withColumnRenamed("n", "n_right"), ["k"], how).select("k", "n", "task_", "n_right").collect()))
        a = join_fragmented(df, right, ["k"], how, 8)
        assert Counter(map(tuple, a.select("k", "n", "task_", "n_right").collect())) == want
        b = join_salted(df, right.withColumnRenamed("n", "n_right"), ["k"], [(k, n) for k, n in hot_keys(df, ["k"], 50) if k[0]], how)
        assert Counter(map(tuple, b.select("k", "n", "task_", "n_right").collect())) == want


def test_join_places_both_sides_once(spark):
    _, df = skewed(spark, 900)
    right = spark.createDataFrame([("hot", 1)], "k string, m long")
    plan = join_fragmented(df, right, ["k"], "inner", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert aggregate_balanced(df, ["k"], {"c": F.count(F.lit(1))}, {"c": F.sum("c")}).collect() == []
    assert join_fragmented(df, df, ["k"], "left").collect() == []
