"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load.

Three steps, each bounded by the number of tasks and never by the number of keys:

1. *Load*: rows per key, combined on the map side. Keys above ``1 / (FINE * tasks)`` of all rows are
   known by name (at most ``FINE * tasks`` of them); the rest is known as totals of hash groups.
2. *Plan*: a named key larger than a task's fair share is cut into proportionate shards; shards, small
   named keys and hash groups are bin-packed to tasks, largest first to the least loaded task.
3. *Placement*: rows go to the task of their shard. In a join, the matching side is copied only to the
   tasks that hold shards of its key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import fresh, parallelism

FINE = 20
GROUPS_PER_TASK = 4


@dataclass
class LoadPlan:
    """Where rows go: ``named`` maps a key tuple to the tasks of its shards, ``groups`` a hash group to its task.

    Tasks are given by numbers that Spark's hash partitioning sends to one partition each.
    """

    keys: list[str]
    tasks: int
    total: int
    named: list[tuple[tuple, list[int]]]
    groups: list[int]
    task_load: list[float]


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Estimate the rows per key of ``df`` and bin-pack them to ``tasks``.

    Null is a key like any other. An empty frame gives a plan with no named key.
    """
    tasks = tasks or parallelism(df.sparkSession)
    n_groups = GROUPS_PER_TASK * tasks
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load_"))
    total = df.select(F.lit(1)).count()
    floor = max(2, total // (FINE * tasks))
    big = F.col("load_") >= floor
    rows = (
        counted.select(
            F.when(big, F.struct(*keys)).alias("key_"),
            F.when(~big, _group(keys, n_groups)).alias("group_"),
            "load_",
        )
        .groupBy("key_", "group_")
        .agg(F.sum("load_").alias("load_"))
        .collect()
    )
    units: list[tuple[float, int, tuple | None, int]] = []
    share = max(1.0, total / tasks)
    for i, r in enumerate(rows):
        if r["group_"] is None:
            shards = max(1, round(r["load_"] / share + 0.49))
            units += [(r["load_"] / shards, i, tuple(r["key_"]), -1)] * shards
        else:
            units.append((r["load_"], i, None, r["group_"]))
    heap = [(0.0, t) for t in range(tasks)]
    named: dict[int, tuple[tuple, list[int]]] = {}
    groups = [g % tasks for g in range(n_groups)]
    load = [0.0] * tasks
    for rows_of, i, key, group in sorted(units, key=lambda u: (-u[0], u[1])):
        so_far, t = heapq.heappop(heap)
        heapq.heappush(heap, (so_far + rows_of, t))
        load[t] += rows_of
        if key is None:
            groups[group] = t
        else:
            named.setdefault(i, (key, []))[1].append(t)
    number = task_numbers(df.sparkSession, tasks)
    return LoadPlan(keys, tasks, total, [(k, [number[t] for t in at]) for k, at in named.values()], [number[t] for t in groups], load)


def task_numbers(spark: SparkSession, tasks: int) -> list[int]:
    """For each of ``tasks`` partitions an integer that hash partitioning sends there."""
    found: dict[int, int] = {}
    start, many = 0, 16 * tasks
    while len(found) < tasks:
        numbers = spark.range(start, start + many).select(F.col("id").cast("int").alias("i"))
        for r in numbers.groupBy(F.pmod(F.hash("i"), F.lit(tasks)).alias("p")).agg(F.min("i").alias("i")).collect():
            found.setdefault(r["p"], r["i"])
        start += many
    return [found[p] for p in range(tasks)]


def _group(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def _with_tasks(df: DataFrame, plan: LoadPlan, tasks_col: str) -> DataFrame:
    """Add the array of tasks on which the row's key lives.

    The broadcast tables have at most ``FINE * tasks`` and ``GROUPS_PER_TASK * tasks`` rows.
    """
    spark = df.sparkSession
    kinds = [df.schema[k] for k in plan.keys]
    key_names = [fresh(df, f"plan_key_{i}") for i in range(len(kinds))]
    named_at, group_at, group, group_col = (fresh(df, n) for n in ("named_at_", "group_at_", "group_no_", "plan_group_"))
    named = spark.createDataFrame(
        [(*key, at) for key, at in plan.named],
        T.StructType([*(T.StructField(n, k.dataType) for n, k in zip(key_names, kinds)), T.StructField(named_at, T.ArrayType(T.IntegerType()))]),
    )
    groups = spark.createDataFrame([(g, [t]) for g, t in enumerate(plan.groups)], f"`{group}` int, `{group_at}` array<int>")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(plan.keys, key_names)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return (
        df.withColumn(group_col, _group(plan.keys, len(plan.groups)))
        .join(F.broadcast(named), condition, "left")
        .join(F.broadcast(groups), F.col(group_col) == F.col(group), "left")
        .withColumn(tasks_col, F.coalesce(named_at, group_at))
        .drop(group_col, group, named_at, group_at, *key_names)
    )


def place(df: DataFrame, plan: LoadPlan, task_col: str, spread: list[str] | None = None) -> DataFrame:
    """Move every row to the task of its shard; ``task_col`` names the task.

    ``spread`` are the columns whose hash chooses the shard of a split key (default: all columns), so
    a retry of a lost task makes the same choice. One exchange, on the task alone.
    """
    at = fresh(df, "tasks_")
    salt = F.xxhash64(*[F.col(c) for c in (spread or df.columns)])
    placed = _with_tasks(df, plan, at).withColumn(
        task_col, F.element_at(F.col(at), (F.pmod(salt, F.size(at)) + 1).cast("int"))
    )
    return placed.drop(at).repartition(plan.tasks, task_col)


def aggregate_balanced(
    df: DataFrame,
    keys: list[str],
    partial: dict[str, Column],
    final: dict[str, Column],
    tasks: int | None = None,
    spread: list[str] | None = None,
    plan: LoadPlan | None = None,
) -> DataFrame:
    """Aggregate per key without a task that holds a whole large key.

    ``partial`` is computed per shard from the input's columns, ``final`` per key from the partial
    columns. With ``spread`` the rows that agree in these columns stay in one shard, so distinct
    counts over them may be summed. Null keys form a group; an empty input gives no row.
    """
    plan = plan or plan_load(df, keys, tasks)
    task = fresh(df, "task_")
    per_shard = place(df, plan, task, spread).groupBy(task, *keys).agg(*[c.alias(n) for n, c in partial.items()])
    return per_shard.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def join_fragmented(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    tasks: int | None = None,
    spread: list[str] | None = None,
    plan: LoadPlan | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """Equi-join in which a large key of ``left`` is split and its matches are copied to its shards only.

    ``how`` is inner or left. Null keys never match (left keeps such rows). Columns of ``right`` other
    than the keys get ``suffix`` where they clash with a column of ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    plan = plan or plan_load(left, keys, tasks)
    task = fresh([*left.columns, *right.columns], "task_")
    at = fresh([*left.columns, *right.columns], "tasks_")
    renamed = right
    taken = {c.lower() for c in left.columns}
    for c in right.columns:
        if c not in keys and c.lower() in taken:
            renamed = renamed.withColumnRenamed(c, fresh([*left.columns, *renamed.columns], c + suffix))
    copied = (
        _with_tasks(renamed.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))), plan, at)
        .withColumn(task, F.explode(F.array_distinct(F.col(at))))
        .drop(at)
        .repartition(plan.tasks, task)
    )
    return place(left, plan, task, spread).join(copied, [task, *keys], how).drop(task)


def hot_keys(df: DataFrame, keys: list[str], rows_per_shard: int, most: int = 10_000) -> list[tuple[tuple, int]]:
    """Keys with more than ``rows_per_shard`` rows and the shards they need, the ``most`` largest.

    What is left out has less than 1 / ``most`` of all rows, so it holds up no task and the list stays bounded.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load_")).where(F.col("load_") > rows_per_shard)
    found = counted.orderBy(F.desc("load_"), *keys).limit(most).collect()
    return [(tuple(r[k] for k in keys), -(-r["load_"] // rows_per_shard)) for r in found]


def join_salted(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: list[tuple[tuple, int]],
    how: str = "left",
    spread: list[str] | None = None,
) -> DataFrame:
    """Equi-join by hash in which the keys of ``hot`` are cut into shards and their matches copied to each.

    The cheap form of :func:`join_fragmented` where even load of the other keys is left to hashing. The
    table of hot keys is broadcast; ``hot_keys`` bounds it.
    """
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    shards = fresh([*left.columns, *right.columns], "shards_")
    salt = fresh([*left.columns, *right.columns], "salt_")
    plan = spark.createDataFrame(
        [(*k, n) for k, n in hot],
        T.StructType([*(left.schema[k] for k in keys), T.StructField(shards, T.IntegerType())]),
    )
    mixed = F.xxhash64(*[F.col(c) for c in (spread or left.columns)])
    one = F.coalesce(F.col(shards), F.lit(1))
    a = left.join(F.broadcast(plan), keys, "left").withColumn(salt, F.pmod(mixed, one).cast("int")).drop(shards)
    b = (
        right.join(F.broadcast(plan), keys, "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1)))
        .drop(shards)
    )
    return a.join(b, [*keys, salt], how).drop(salt)
