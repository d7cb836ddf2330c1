"""Attributes as known at event time: bitemporal as-of join.

A statement counts at time t once it is both valid (``valid_from <= t``) and recorded (``known_at <=
t``), that is from its *availability* max(valid_from, known_at) on. Per entity the statements in order
of availability, each with the best statement so far (greatest valid_from, then known_at, then tie
column), are its current-state versions; an event takes the last version available at its time.

Entities are hash-partitioned into buckets; in each bucket an embedded DuckDB builds the versions and
runs ``ASOF LEFT JOIN``. Statements of equal availability are reduced to the best one before any row is
shuffled (tie resolution). The rows of an entity with more than ``rows_per_bucket`` statements and events are
sorted by time, statements before events of the same time, and cut into slices of that many rows; each slice starts
with the best statement of all earlier ones. So no bucket depends on the size of one entity, and nothing about
entities is collected or broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.past import with_sequence
from tidemark.session import durable, fresh, parallelism

LOWEST = -(2**63)


@dataclass(frozen=True)
class Statements:
    """Column names of a table of statements; times are epoch seconds (long)."""

    entity: str
    valid_from: str
    known_at: str
    tie: str
    payload: tuple[str, ...]


@dataclass(frozen=True)
class Events:
    """Column names of a table of events; ``keys`` come back in the result."""

    entity: str
    at: str
    keys: tuple[str, ...]


def seconds(c: str, limit: int = 100_000_000_000):
    """Epoch seconds of a column in which values above ``limit`` are milliseconds."""
    return F.when(F.col(c) > limit, F.floor(F.col(c) / 1000).cast("long")).otherwise(F.col(c).cast("long"))


_SQL = """
WITH versions AS (
    SELECT e, s, a, max(cur) OVER (PARTITION BY e, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS cur
    FROM (SELECT e, s, a, {{'v': v, 'k': k, 'r': r, 'p': p}} AS cur FROM statements)
)
SELECT {keys}, {payload} FROM events
ASOF LEFT JOIN versions ON events.e = versions.e AND events.s = versions.s AND events.t >= versions.a
"""


def known_at_event_time(
    events: DataFrame,
    statements: DataFrame,
    ev: Events,
    st: Statements,
    rows_per_bucket: int = 500_000,
) -> DataFrame:
    """Each distinct event with the payload that was valid and known at its time.

    Returns ``ev.keys`` and ``st.payload``; the payload is null where nothing was known. Exact copies
    of an event give one row. Events without entity or time are kept with a null payload; statements
    without entity, valid_from or known_at are never known. A null tie value ranks lowest. Other
    columns of either table, whatever their names, are ignored; a payload column named like a key
    comes back with ``_known`` behind its name.
    """
    spark = events.sparkSession
    key_of = {f"k{i}": k for i, k in enumerate(ev.keys)}
    pay_of = {f"p{i}": p for i, p in enumerate(st.payload)}
    e = events.select(F.col(ev.entity).alias("e"), F.col(ev.at).cast("long").alias("t"), *[F.col(k).alias(n) for n, k in key_of.items()]).distinct()
    s = statements.select(
        F.col(st.entity).alias("e"),
        F.greatest(F.col(st.valid_from), F.col(st.known_at)).cast("long").alias("a"),
        F.struct(
            F.col(st.valid_from).cast("long").alias("v"),
            F.col(st.known_at).cast("long").alias("k"),
            F.coalesce(F.col(st.tie).cast("long"), F.lit(LOWEST)).alias("r"),
            F.struct(*[F.col(p).alias(n) for n, p in pay_of.items()]).alias("p"),
        ).alias("cur"),
        F.col(st.valid_from).isNotNull().alias("has_v"),
        F.col(st.known_at).isNotNull().alias("has_k"),
    ).where("e IS NOT NULL AND has_v AND has_k")
    s = s.groupBy("e", "a").agg(F.max("cur").alias("cur"))

    load = (
        s.select("e", F.lit(1).alias("n"))
        .unionByName(e.where("e IS NOT NULL").select("e", F.lit(1).alias("n")))
        .groupBy("e").agg(F.sum("n").alias("n"))
    )
    large = F.col("n") > rows_per_bucket
    sizes = load.agg(F.sum("n").alias("n"), F.count_if(large).alias("large")).collect()[0]
    buckets = max(parallelism(spark), math.ceil(2 * (sizes["n"] or 0) / rows_per_bucket))
    if sizes["large"]:
        e, s = _sliced(e, s, durable(load.where(large).select("e")), list(key_of), rows_per_bucket)
    else:
        e, s = e.withColumn("s", F.lit(0).cast("long")), s.withColumn("s", F.lit(0).cast("long"))
    bucket = F.pmod(F.xxhash64("e", "s"), F.lit(buckets)).cast("int")
    # an event without entity has no partner anywhere: its bucket comes from its keys, so that many of them spread out
    own = F.pmod(F.xxhash64(*[F.col(k) for k in key_of]), F.lit(buckets)).cast("int")
    left = e.select(F.when(F.col("e").isNull(), own).otherwise(bucket).alias("b"), "e", "s", "t", *key_of)
    right = s.select(bucket.alias("b"), "e", "s", "a", "cur.v", "cur.k", "cur.r", "cur.p")

    out = T.StructType(
        [T.StructField(k, events.schema[k].dataType) for k in ev.keys]
        + [T.StructField(fresh(list(ev.keys), p + "_known") if p in ev.keys else p, statements.schema[p].dataType) for p in st.payload]
    )
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    sql = _SQL.format(
        keys=", ".join(f"events.{n} AS o{i}" for i, n in enumerate(key_of)),
        payload=", ".join(f"versions.cur.p.{n} AS {quoted('q' + n)}" for n in pay_of),
    )
    arrow_out = to_arrow_schema(out)

    def bucket_join(a: pa.Table, b: pa.Table) -> pa.Table:
        import duckdb

        # a bucket is bounded, so nothing is ever spilled to a folder of the machine
        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as db:
            db.register("events", a)
            db.register("statements", b)
            result = db.sql(sql).to_arrow_table()
        return pa.table([c.cast(f.type) for c, f in zip(result.columns, arrow_out)], schema=arrow_out)

    return left.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(bucket_join, out)


def _sliced(e: DataFrame, s: DataFrame, large: DataFrame, keys: list[str], rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Events and statements with slice ``s``: 0 but for the ``large`` entities, whose slices have ``rows_per_bucket`` rows."""
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # both kinds in one sort; a statement comes before the events of its time
    rows = s.join(large, "e", "left_semi").select("e", F.col("a").alias("t"), F.lit(0).alias("kind"), "cur", *[nothing(e, k) for k in keys]).unionByName(
        e.join(large, "e", "left_semi").select("e", "t", F.lit(1).alias("kind"), nothing(s, "cur"), *keys)
    )
    placed = with_sequence(rows, ["e", "t", "kind", *keys], "at_")
    first = placed.groupBy("e").agg(F.min("at_").alias("first_"))
    placed = placed.join(first, "e").withColumn("s", F.floor((F.col("at_") - F.col("first_")) / rows_per_bucket).cast("long"))
    said = placed.where("kind = 0").select("e", F.col("t").alias("a"), "cur", "s")
    # per entity one row a slice: the best statement of the earlier ones is where a slice starts
    before = W.partitionBy("e").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    best = placed.groupBy("e", "s").agg(F.max("cur").alias("cur"))
    carry = best.withColumn("cur", F.max("cur").over(before)).where("cur IS NOT NULL").select("e", F.lit(LOWEST).alias("a"), "cur", "s")
    zero = F.lit(0).cast("long").alias("s")
    rest = e.join(large, "e", "left_anti").select("e", "t", *keys, zero)
    return (
        rest.unionByName(placed.where("kind = 1").select("e", "t", *keys, "s")),
        s.join(large, "e", "left_anti").select("e", "a", "cur", zero).unionByName(said).unionByName(carry),
    )
