"""Features of the strict past: what was known before each event, and nothing later.

Sums over the past are taken in blocks of the time axis: a window inside the block plus the total of all
earlier blocks. So neither the whole stream nor the rows of a frequent key ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import durable, fresh

BLOCK_ROWS = 1 << 20


def with_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Add the dense position (from 0) in the total order of ``order``; nulls come first.

    A range-partitioned sort is written once; positions are the row's place in its partition plus
    the rows of earlier partitions (one number per partition). ``order`` should end in a unique column:
    rows equal in all of it get positions in no defined order. An empty frame stays empty.
    """
    placed = durable(df.orderBy(*order)).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, 33).cast("int")
    counts = sorted(placed.groupBy(part.alias("part_")).count().collect())
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["part_"], before))
        before += r["count"]
    column = fresh(placed, "part_")
    start = fresh(placed, "start_")
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{column} int, {start} long"))
    return (
        placed.withColumn(column, part).join(table, column, "left")
        .withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(start))
        .drop(column, start)
    )


_HOW = {"sum": F.sum, "max": F.max, "min": F.min}


def strict_past(
    df: DataFrame, keys: list[str], seq: str, facts: dict[str, tuple[str, Column]], block_rows: int = BLOCK_ROWS, inclusive: bool = False
) -> DataFrame:
    """Add, per row, sums, maxima or minima over the earlier rows of the same keys.

    ``facts`` maps a new column to (sum | max | min, expression). Without earlier rows a sum is 0, a
    maximum or minimum null. Null keys are a group. ``inclusive`` takes the row itself in. Rows of equal
    keys should differ in ``seq``.
    """
    taken = [*df.columns, *facts]
    block, of_block = fresh(taken, "block_"), fresh(taken, "of_block_")
    key_of = {k: fresh(taken, f"key_{i}_") for i, k in enumerate(keys)}
    past_of = {n: fresh(taken, f"past_{n}_") for n in facts}
    df = df.withColumn(block, F.floor(F.col(seq) / block_rows))
    upto = 0 if inclusive else -1
    inside = W.partitionBy(*keys, block).orderBy(seq).rowsBetween(W.unboundedPreceding, upto)
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[_HOW[how](x).alias(n) for n, (how, x) in facts.items()])
    totals = totals.select(
        *[F.col(k).alias(n) for k, n in key_of.items()], F.col(block).alias(of_block),
        *[_HOW[how](F.col(n)).over(before).alias(past_of[n]) for n, (how, _) in facts.items()],
    )
    same = F.col(block) == F.col(of_block)
    for k, n in key_of.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    out = df.withColumns({n: _HOW[how](x).over(inside) for n, (how, x) in facts.items()}).join(totals, same, "left")
    for n, (how, _) in facts.items():
        own, past = F.col(n), F.col(past_of[n])
        if how == "sum":
            out = out.withColumn(n, F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0)))
        else:
            out = out.withColumn(n, (F.greatest if how == "max" else F.least)(own, past))
    return out.drop(block, of_block, *key_of.values(), *past_of.values())


def recent_past(df: DataFrame, seq: str, k: int, facts: dict[str, Column], inclusive: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add aggregates over the last ``k`` rows before each (or up to each, if ``inclusive``).

    ``seq`` must be dense. The last rows of a block are copied to the next one, so blocks are windows
    of their own. ``facts`` maps names to aggregate expressions such as ``F.avg("y")``.
    """
    block, own = fresh(df, "block_"), fresh(df, "own_")
    rows = max(block_rows, k + 1)
    home = F.floor(F.col(seq) / rows)
    at_end = F.col(seq) % rows >= rows - k
    spread = df.withColumn(block, F.explode(F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home)))).withColumn(own, home == F.col(block))
    frame = W.partitionBy(block).orderBy(seq).rowsBetween(-k + 1 if inclusive else -k, 0 if inclusive else -1)
    return spread.withColumns({n: x.over(frame) for n, x in facts.items()}).where(own).drop(block, own)


def smoothed(bad: Column, total: Column, base: Column, m: float = 5.0) -> Column:
    """(bad + m base) / (total + m)."""
    return (bad + F.lit(m) * base) / (total + F.lit(m))


def with_global_prior(ev: DataFrame, seq: str = "seq", label: str = "y", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``past_n``, ``past_bad`` and ``global_rate`` (0 before the first event)."""
    out = strict_past(ev, [], seq, {"past_bad": ("sum", F.col(label)), "past_n": ("sum", F.lit(1))}, block_rows)
    return out.withColumn("global_rate", F.coalesce(F.try_divide("past_bad", "past_n"), F.lit(0.0)))


def with_actor_prior(ev: DataFrame, seq: str = "seq", label: str = "y", actor: str = "actor", m: float = 5.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``actor_n``, ``actor_bad``, ``actor_rate``; needs ``global_rate``."""
    out = strict_past(ev, [actor], seq, {"actor_bad": ("sum", F.col(label)), "actor_n": ("sum", F.lit(1))}, block_rows)
    return out.withColumn("actor_rate", smoothed(F.col("actor_bad"), F.col("actor_n"), F.col("global_rate"), m))


def hub_prior(hubs: DataFrame, ev: DataFrame, id: str = "id", seq: str = "seq", hub: str = "hub", m: float = 5.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per event mean and maximum of its hubs' smoothed past rates, and the greatest past use of a hub.

    ``hubs`` has distinct (id, seq, y, hub); ``ev`` has ``global_rate``. Events without hubs get the
    global rate and 0.
    """
    used = strict_past(hubs, [hub], seq, {"hub_bad": ("sum", F.col("y")), "hub_n": ("sum", F.lit(1))}, block_rows)
    rated = used.join(ev.select(id, "global_rate"), id)
    per_event = rated.withColumn("r_", smoothed(F.col("hub_bad"), F.col("hub_n"), F.col("global_rate"), m)).groupBy(id).agg(
        F.avg("r_").alias("hub_mean"), F.max("r_").alias("hub_max"), F.max("hub_n").alias("max_churn")
    )
    return ev.join(per_event, id, "left").withColumns(
        {
            "hub_mean": F.coalesce("hub_mean", "global_rate"),
            "hub_max": F.coalesce("hub_max", "global_rate"),
            "max_churn": F.coalesce("max_churn", F.lit(0)),
        }
    )


def expanding_z(df: DataFrame, seq: str, x: str, name: str, least: int = 30, floor: float = 1e-9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the z-score of ``x`` against its strict past; 0 until more than ``least`` rows have passed."""
    v = F.col(x).cast("double")
    out = strict_past(df, [], seq, {"z_n_": ("sum", F.lit(1)), "z_s_": ("sum", v), "z_q_": ("sum", v * v)}, block_rows)
    mean = F.try_divide("z_s_", "z_n_")
    var = F.greatest(F.try_divide("z_q_", "z_n_") - mean * mean, F.lit(floor))
    return out.withColumn(name, F.when(F.col("z_n_") > least, (v - mean) / F.sqrt(var)).otherwise(0.0)).drop("z_n_", "z_s_", "z_q_")


def expanding_zs(df: DataFrame, seq: str, columns: list[str], least: int = 30, floor: float = 1e-9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`expanding_z` of several columns in one pass, as ``z_`` and the column's name; nulls count as 0."""
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    facts = {"z_n_": ("sum", F.lit(1))} | {f"s_{c}_": ("sum", x) for c, x in v.items()} | {f"q_{c}_": ("sum", x * x) for c, x in v.items()}
    out = strict_past(df, [], seq, facts, block_rows)
    mean = {c: F.try_divide(f"s_{c}_", "z_n_") for c in columns}
    sd = {c: F.sqrt(F.greatest(F.try_divide(f"q_{c}_", "z_n_") - mean[c] * mean[c], F.lit(floor))) for c in columns}
    return out.withColumns({f"z_{c}": F.when(F.col("z_n_") > least, (v[c] - mean[c]) / sd[c]).otherwise(0.0) for c in columns}).drop(*facts)


def first_use(df: DataFrame, keys: list[str], seq: str, name: str = "is_first") -> DataFrame:
    """Add 1 to the first row of each combination of keys, else 0."""
    first = fresh(df, "first_")
    firsts = df.groupBy(*keys).agg(F.min(seq).alias(first))
    return df.join(firsts, keys, "left").withColumn(name, F.coalesce((F.col(seq) == F.col(first)).cast("int"), F.lit(0))).drop(first)
