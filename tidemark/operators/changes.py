"""Rebuilding a table from a feed of inserts, updates, deletes and moves.

A commutative fold. Every fact about a key is a struct that starts with its sequence number, and only
maxima and minima of such structs are kept, so repeated, late and reordered deliveries change nothing:

1. per sequence number the maximum of (delivery, content): each change counts once;
2. per key the maximal *tombstone* (sequence of the last delete, from the feed, from the deletion of a
   whole group, or from a base row that isn't alive); tombstones are kept, so that a change that comes
   in after them but belongs before them stays without effect;
3. per key, above its tombstone, the minimal insert (it makes the key alive; later inserts do nothing)
   and the maximal update (it holds if it lies above that insert).

Base rows take part as inserts or tombstones below every sequence number.

What step 1 keeps is the *state* (:func:`fold_changes`): one row per sequence number, and one per key of the base.
It is a fold itself, so a feed may come in parts, in any order, with deliveries of one change in several parts; each
part is folded into the written state of those before, and :func:`current_rows` takes steps 2 and 3 at any
time. Where no change up to a sequence number can come any more, :func:`settle` puts one row per key, the dead
as tombstones, in the place of all facts up to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import hot_keys, join_salted

BASE = -(2**63) + 1


@dataclass(frozen=True)
class Feed:
    """Columns of a change feed. ``payload`` maps output columns to the change columns that set them."""

    sequence: str
    delivery: str
    op: str
    key: str
    group: str
    payload: dict[str, str]
    fixed: dict[str, str]


@dataclass(frozen=True)
class Base:
    """Columns of the table before the first change; ``payload`` and ``fixed`` map output to base columns."""

    key: str
    group: str
    alive: str
    payload: dict[str, str]
    fixed: dict[str, str]


def op_name(c: Column) -> Column:
    """INSERT, UPDATE, DELETE, MOVE or null from ADDS, UPDATES, REMOVES, MOVES in any case and spacing."""
    word = F.upper(F.regexp_replace(c, r"\s+", ""))
    return (
        F.when(word == "ADDS", "INSERT").when(word == "UPDATES", "UPDATE").when(word == "REMOVES", "DELETE").when(word == "MOVES", "MOVE")
    )


def group_of_key(key: Column, separator: str = "::") -> Column:
    """The part of a key before the first separator; null for a key without one."""
    return F.when(F.instr(key, separator) > 0, F.substring_index(key, separator, 1))


def _group(group: str, key: str, separator: str) -> Column:
    return F.coalesce(F.col(group), group_of_key(F.col(key), separator))


def base_state(base: DataFrame, fb: Base, separator: str = "::") -> DataFrame:
    """The rows of a table as state: one fact below every sequence number per key."""
    content = F.struct(
        F.coalesce(F.col(fb.alive), F.lit(False)).alias("alive"),
        _group(fb.group, fb.key, separator).alias("grp"),
        *[F.col(c).alias(f"x_{n}") for n, c in {**fb.payload, **fb.fixed}.items()],
    )
    rows = base.where(F.col(fb.key).isNotNull()).groupBy(F.col(fb.key).alias("key")).agg(F.max(content).alias("c"))
    op = F.when(F.col("c.alive"), "INSERT").otherwise("DELETE").alias("op")
    return rows.select(
        F.lit(True).alias("settled"), F.lit(BASE).alias("seq"), F.lit(0).cast("long").alias("delivery"), op, "key", "c.grp", *[F.col(f"c.x_{n}") for n in {**fb.payload, **fb.fixed}]
    )


def fold_changes(feed: DataFrame, ff: Feed, state: DataFrame | None = None, after: int | None = None, separator: str = "::") -> DataFrame:
    """``settled, seq, delivery, op, key, grp`` and the contents: the state with a part of a feed folded in.

    Of each sequence number the content of the greatest delivery is kept, whichever part it came in. Changes
    without sequence are left out, and so are those up to ``after``, the number up to which the state is settled.
    """
    names = [*ff.payload, *ff.fixed]
    content = F.struct("delivery", "op", "key", "grp", *[F.col(f"x_{n}") for n in names])
    facts = feed.where(F.col(ff.sequence).isNotNull()).select(
        F.col(ff.sequence).cast("long").alias("seq"), F.col(ff.delivery).cast("long").alias("delivery"), op_name(F.col(ff.op)).alias("op"), F.col(ff.key).alias("key"),
        _group(ff.group, ff.key, separator).alias("grp"), *[F.col(c).alias(f"x_{n}") for n, c in {**ff.payload, **ff.fixed}.items()],
    )
    if after is not None:
        facts = facts.where(F.col("seq") > after)
    if state is None:
        return facts.groupBy("seq").agg(F.max(content).alias("c")).select(F.lit(False).alias("settled"), "seq", "c.*")
    facts = facts.unionByName(state.where("NOT settled").drop("settled"))
    once = facts.groupBy("seq").agg(F.max(content).alias("c")).select(F.lit(False).alias("settled"), "seq", "c.*")
    return state.where("settled").unionByName(once)


def _wanted(names: list[str]) -> None:
    clash = {"key", "grp", "alive", "set_by", "as_of"} & {n.lower() for n in names}
    if clash or len(set(names)) < len(names):
        raise ValueError(f"payload and fixed columns need names of their own: {sorted(clash)}")


def current_rows(
    state: DataFrame, payload: list[str], fixed: list[str], tombstones: bool = False, rows_per_shard: int = 1_000_000, sizes: DataFrame | None = None
) -> DataFrame:
    """The table that a state stands for: key, group, payload, fixed columns, alive, set_by, as_of.

    ``as_of`` is the sequence number that made the row what it is: of its last update, of the insert, or, for a
    dead row, of its last tombstone. ``sizes`` (key, grp) may stand in for the state where rows of hot keys are counted.
    """
    names = [*payload, *fixed]
    _wanted(names)
    facts = state.where("key IS NOT NULL AND op IN ('INSERT', 'UPDATE', 'DELETE')")
    group_ends = state.where("key IS NULL AND op = 'DELETE' AND grp IS NOT NULL").groupBy("grp").agg(F.max("seq").alias("end_"))
    sizes = state if sizes is None else sizes
    hot = [(k, n) for k, n in hot_keys(sizes, ["key"], rows_per_shard) if k[0] is not None]
    hot_groups = [(k, n) for k, n in hot_keys(sizes, ["grp"], rows_per_shard) if k[0] is not None]

    own_end = facts.groupBy("key").agg(F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).alias("own_"), F.max("grp").alias("grp"))
    ends = (
        join_salted(own_end, group_ends, ["grp"], hot_groups, "left", ["key"])
        .select("key", F.greatest("own_", "end_").alias("end_"))
        .where("end_ IS NOT NULL")
    )
    fact = F.struct("seq", "delivery", "grp", *[F.col(f"x_{n}") for n in names])
    living = join_salted(facts.where("op <> 'DELETE'"), ends, ["key"], hot, "left", ["seq"]).where("end_ IS NULL OR seq > end_")
    lives = living.groupBy("key").agg(
        F.min(F.when(F.col("op") == "INSERT", fact)).alias("first_"),
        F.max(F.when(F.col("op") == "UPDATE", fact)).alias("last_"),
    )
    updated = F.col("last_.seq") > F.col("first_.seq")
    held = lambda n: F.when(updated, F.col(f"last_.{n}")).otherwise(F.col(f"first_.{n}"))
    columns = [
        "key",
        F.col("first_.grp").alias("grp"),
        *[held(f"x_{n}").alias(n) for n in payload],
        *[F.col(f"first_.x_{n}").alias(n) for n in fixed],
        F.col("first_").isNotNull().alias("alive"),
        held("delivery").alias("set_by"),
        held("seq").alias("as_of"),
    ]
    if not tombstones:
        return lives.where("first_ IS NOT NULL").select(*columns)
    every = own_end.select("key", F.col("grp").alias("known_")).join(lives, "key", "left").join(ends, "key", "left")
    columns[1] = F.coalesce(F.col("first_.grp"), F.col("known_")).alias("grp")
    columns[-1] = F.coalesce(held("seq"), F.col("end_")).alias("as_of")
    return every.select(*columns)


def settle(state: DataFrame, upto: int, payload: list[str], fixed: list[str], rows_per_shard: int = 1_000_000) -> DataFrame:
    """A smaller state in which all facts up to ``upto`` are one row per key, dead keys a tombstone.

    Everything above ``upto`` may still come in any order; give ``upto`` as ``after`` to :func:`fold_changes` then.
    """
    old = current_rows(state.where(F.col("seq") <= upto), payload, fixed, True, rows_per_shard)
    op = F.when(F.col("alive"), "INSERT").otherwise("DELETE").alias("op")
    rows = old.select(
        F.lit(True).alias("settled"), F.coalesce("as_of", F.lit(BASE)).alias("seq"), F.coalesce("set_by", F.lit(0).cast("long")).alias("delivery"), op, "key", "grp",
        *[F.col(n).alias(f"x_{n}") for n in [*payload, *fixed]],
    )
    return rows.unionByName(state.where(F.col("seq") > upto))


def apply_changes(
    base: DataFrame,
    feed: DataFrame,
    fb: Base,
    ff: Feed,
    tombstones: bool = False,
    rows_per_shard: int = 1_000_000,
    separator: str = "::",
) -> DataFrame:
    """The table after the last change: key, group, payload, fixed columns, alive, set_by, as_of.

    ``payload`` is what inserts and updates set, ``fixed`` what the insert that made the row alive set.
    ``set_by`` is the delivery that last set the payload, 0 for the base row's. With ``tombstones`` dead
    rows come too (alive false, payload and fixed null, set_by null). A delete without key kills all
    keys of its group; other changes without key, changes without sequence and unknown operations do
    nothing. Exact copies of base rows count once; of differing base rows of one key the one that is
    alive, then the greatest, holds. Empty tables are fine. A null group of a change or base row is
    taken from its key. Extra columns are ignored.
    """
    _wanted([*ff.payload, *ff.fixed])
    state = fold_changes(feed, ff, base_state(base, fb, separator), None, separator)
    sizes = feed.select(F.col(ff.key).alias("key"), _group(ff.group, ff.key, separator).alias("grp")).unionByName(
        base.select(F.col(fb.key).alias("key"), _group(fb.group, fb.key, separator).alias("grp"))
    )
    return current_rows(state, list(ff.payload), list(ff.fixed), tombstones, rows_per_shard, sizes)
