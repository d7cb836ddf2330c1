"""Pairs of items that occur together, by heavy-light decomposition.

Items get numbers by falling frequency. An item is *heavy* if it is in more than 1/32 of all records: a
bit row is then smaller than a list of record numbers. As the records of all items add up to n times the
mean length of a record, there are at most 32 times that mean of heavy items. The rest is *light*. In
every partition of records

* heavy with heavy: rows of a dense bit matrix are combined, block by block, and their bits counted;
* heavy with light: the record list of the light item probes the bits of all heavy items;
* light with light: the pairs of a record are counted by hash.

The three kinds of partial counts leave a partition as numbers, are united, added up by pair and scored
against chance; names are looked up last.

Numbers and names of the ``looked_up`` most frequent items are broadcast, those of all others joined. An
item beyond these is in less than 1 / looked_up of all tokens, so no join has a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.past import with_sequence
from tidemark.session import durable

OUT = "a long, b long, n long"
PAIR_BLOCK = 4_000_000
BIT_BLOCK = 512
BIT_ROOM = 64_000_000  # cells of a bit matrix, and of a matrix of counts of heavy pairs
LOOKED_UP = 50_000
SHIFT = 32  # two numbers below 2^31 in one


def _emit(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


class PairCounts:
    """Counts of pairs by number; held until there are more than PAIR_BLOCK, then passed on."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.wait.append((np.minimum(a, b) << SHIFT | np.maximum(a, b), np.ones(len(a), dtype=np.int64) if n is None else n))
            self.held += len(a)
        if self.held >= PAIR_BLOCK:
            self._merge()
            if len(self.keys) >= PAIR_BLOCK // 2:
                yield from self.flush()

    def _merge(self) -> None:
        keys, n = np.concatenate([self.keys, *(k for k, _ in self.wait)]), np.concatenate([self.n, *(c for _, c in self.wait)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.n = keys[start], np.add.reduceat(n[order], start) if len(start) else n
        self.wait, self.held = [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if len(self.keys):
            yield _emit(self.keys >> SHIFT, self.keys & ((1 << SHIFT) - 1), self.n)
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


def _record_pairs(sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within each run of ``ids``, in blocks of bounded size."""
    first_of = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(ids)) - first_of
    lens = np.repeat(sizes, sizes) - 1 - place  # partners that come later in the record
    upto = np.cumsum(lens)
    row = 0
    while row < len(ids):
        done = int(upto[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(upto, done + PAIR_BLOCK, side="right")))
        own = lens[row:end]
        total = int(own.sum())
        if total:
            a = np.repeat(np.arange(row, end), own)
            b = a + 1 + np.arange(total) - np.repeat(np.cumsum(own) - own, own)
            yield ids[a], ids[b]
        row = end


def count_pairs(batches: Iterator[pa.RecordBatch], n_heavy: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of one partition of records, each a list of numbers; those below ``n_heavy`` are heavy."""
    both = np.zeros((n_heavy, n_heavy), dtype=np.int64) if n_heavy**2 <= BIT_ROOM else None
    counts = PairCounts()
    step = max(1, BIT_ROOM // max(1, n_heavy))
    for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
        lists = batch.column(0)
        items = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        is_heavy = items < n_heavy
        # bits[h, r]: record r of the batch has heavy item h
        bits = np.zeros((n_heavy, batch.num_rows), dtype=bool)
        bits[items[is_heavy], row[is_heavy]] = True
        packed = np.packbits(bits, axis=1)
        for h in range(n_heavy - 1):
            for lo in range(h + 1, n_heavy, BIT_BLOCK):
                common = np.bitwise_count(packed[h] & packed[lo : lo + BIT_BLOCK]).sum(axis=1, dtype=np.int64)
                if both is not None:
                    both[h, lo : lo + BIT_BLOCK] += common
                else:
                    x = np.flatnonzero(common)
                    yield from counts.add(np.full(len(x), h), lo + x, common[x])
        light, light_row = items[~is_heavy], row[~is_heavy]
        if not len(light):
            continue
        if n_heavy:
            # the record list of each light item, one after the other, probes the heavy bits of its records
            order = np.argsort(light, kind="stable")
            by_record = np.packbits(bits.T, axis=1)
            most = max(1, BIT_ROOM // 2 // n_heavy)
            for lo in range(0, len(order), most):
                part = order[lo : lo + most]
                probed = np.unpackbits(by_record[light_row[part]], axis=1, count=n_heavy)
                cut = np.flatnonzero(np.r_[True, np.diff(light[part]) > 0])
                found = np.add.reduceat(probed, cut, axis=0, dtype=np.int64)
                x, h = np.nonzero(found)
                yield from counts.add(light[part][cut[x]], h, found[x, h])
        for a, b in _record_pairs(np.bincount(light_row, minlength=batch.num_rows), light):
            yield from counts.add(a, b)
    if both is not None:
        yield from counts.add(*(ab := np.nonzero(both)), both[ab])
    yield from counts.flush()


def _numbered(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of names as lists of numbers; a name that is not in ``names`` is left out."""
    known = pa.array(names, pa.string())
    for batch in batches:
        lists = batch.column(0)
        at = pc.index_in(lists.flatten(), value_set=known)
        kept = pc.is_valid(at)
        sizes = np.bincount(pc.list_parent_indices(lists).filter(kept).to_numpy(zero_copy_only=False), minlength=batch.num_rows)
        yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), at.drop_null().cast(pa.int64()))], names=["numbers"])


def npmi(together: Column, df_a: Column, df_b: Column, n: Column) -> Column:
    """ln(c n / (a b)) / -ln(c / n); 1 where the pair is in every record."""
    return F.when(together == n, 1.0).otherwise(
        F.try_divide(F.log(together * n.cast("double") / (df_a * df_b.cast("double"))), -F.log(together.cast("double") / n))
    )


def pairs_together(
    baskets: DataFrame, record: str, items: str, least_records: int = 3, least_together: int = 3, heavy_share: int = 32, looked_up: int = LOOKED_UP
) -> DataFrame:
    """``term_a < term_b, df_a, df_b, together, n_records, lift, npmi`` of all pairs of items.

    ``baskets`` has one row per record with an array of items; null and repeated items, null arrays
    and empty arrays count as no items (the record still counts in n_records). Items in fewer than
    ``least_records`` records and pairs in fewer than ``least_together`` are left out. Empty tables
    give no row. At most 2^31 items are told apart; more raise an error.
    """
    spark = baskets.sparkSession
    kept = durable(baskets.select(F.array_compact(F.array_distinct(F.col(items).cast("array<string>"))).alias("items")))
    n = kept.count()
    tokens = kept.select(F.explode("items").alias("term"))
    frequencies = durable(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_records))
    top = frequencies.orderBy(F.desc("df"), "term").limit(looked_up).collect()  # at most looked_up rows
    heavy = sum(r["df"] * heavy_share > n for r in top)
    names = spark.createDataFrame([(i, r["term"], r["df"]) for i, r in enumerate(top)], "no long, term string, df long")
    rest = None
    if len(top) == looked_up:
        others = frequencies.join(F.broadcast(names.select("term")), "term", "left_anti")
        rest = with_sequence(others, ["term"], "no").withColumn("no", F.col("no") + len(top)).select("no", "term", "df")
        if (rest.agg(F.max("no")).collect()[0][0] or 0) >= 1 << 31:
            raise ValueError("more than 2^31 items")
    if rest is None:
        sent = spark.sparkContext.broadcast([r["term"] for r in top])
        numbers = kept.where("items IS NOT NULL").mapInArrow(lambda batches: _numbered(sent.value, batches), "numbers array<long>")
    else:
        rows = kept.where("items IS NOT NULL").withColumn("record", F.monotonically_increasing_id()).select("record", F.explode("items").alias("term"))
        split = rows.join(F.broadcast(names.select("term", "no")), "term", "left")
        joined = split.where("no IS NULL").select("record", "term").join(rest.select("term", "no"), "term").select("record", "no")
        numbers = split.where("no IS NOT NULL").select("record", "no").unionByName(joined).groupBy("record").agg(F.collect_list("no").alias("numbers")).select("numbers")
    counted = numbers.mapInArrow(lambda batches: count_pairs(batches, heavy), OUT)
    pairs = counted.groupBy("a", "b").agg(F.sum("n").alias("together")).where(F.col("together") >= least_together)
    for side in "ab":
        pairs = _named(pairs, side, names, rest)
    swap = F.col("term_a") > F.col("term_b")
    first = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(
        first("term_a", "term_b").alias("term_a"), first("term_b", "term_a").alias("term_b"), first("df_a", "df_b").alias("df_a"), first("df_b", "df_a").alias("df_b"), "together"
    )
    total = F.lit(n).cast("long")
    return pairs.withColumns({
        "n_records": total,
        "lift": F.col("together") * total.cast("double") / (F.col("df_a") * F.col("df_b").cast("double")),
        "npmi": npmi(F.col("together"), F.col("df_a"), F.col("df_b"), total),
    })


def _named(pairs: DataFrame, side: str, names: DataFrame, rest: DataFrame | None) -> DataFrame:
    """Name and frequency of one side: the most frequent from the broadcast table, the rest by join."""
    renamed = lambda df, x="": df.select(F.col("no").alias(side), F.col("term").alias(f"term_{side}{x}"), F.col("df").alias(f"df_{side}{x}"))
    if rest is None:
        return pairs.join(F.broadcast(renamed(names)), side)
    known = pairs.join(F.broadcast(renamed(names)), side)
    return known.unionByName(pairs.join(F.broadcast(names.select(F.col("no").alias(side))), side, "left_anti").join(renamed(rest), side))
