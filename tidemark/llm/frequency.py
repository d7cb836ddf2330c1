"""Occurrences and records of every distinct term, by last-seen counters.

Each term has its occurrences, its records and the last record it was seen in. Tokens come ordered by
record, so a token of another record than the last one raises the records, and no set of terms per
record is ever kept. The counters are kept twice: over the records of an input partition, whose counters
leave it as one row per term with the first and the last record; and in the hash partition of the
term, where these rows, ordered by record, go on counting: a row that starts with the record the row
before it ended with brings one record less. Only counters are shuffled, and a record with very many
rows may lie in any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "term string, occurrences long, records long, first_record string, last_record string"


class Counters:
    """Occurrences, records, first and last record of every term of a partition, by number of the term."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.occurrences = self.records = self.first = self.last = np.zeros(0, dtype=np.int64)

    def codes(self, terms: list[str]) -> np.ndarray:
        """Numbers of ``terms``; new ones get room in the counters."""
        number = self.number
        out = np.array([number.setdefault(t, len(number)) for t in terms], dtype=np.int64)
        if len(number) > len(self.last):
            room = np.zeros(max(len(number), 2 * len(self.last)) - len(self.last), dtype=np.int64)
            self.occurrences, self.records = np.r_[self.occurrences, room], np.r_[self.records, room]
            self.first, self.last = np.r_[self.first, room - 1], np.r_[self.last, room - 1]
        return out

    def see(self, terms: np.ndarray, record: int) -> None:
        """Tokens of one record. A term last seen in another record than this one is in one record more."""
        np.add.at(self.occurrences, terms, 1)
        new = terms[self.last[terms] != record]
        self.records[new] += 1  # an index that is repeated counts once
        self.last[new] = record
        fresh = new[self.first[new] < 0]
        self.first[fresh] = record

    def rows(self, names: list[str]) -> pa.RecordBatch:
        n = len(self.number)
        name = pa.array(names, pa.string())
        columns = [pa.array(list(self.number), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n]), name.take(pa.array(self.first[:n])), name.take(pa.array(self.last[:n]))]
        return pa.record_batch(columns, names=["term", "occurrences", "records", "first_record", "last_record"])


def last_seen_counters(batches: Iterator[pa.RecordBatch], flush_terms: int) -> Iterator[pa.RecordBatch]:
    """Counters of one partition whose rows are (record, text) in order of record."""
    counters, names = Counters(), []
    for batch in batches:
        records = pc.fill_null(batch.column(0), "").to_pylist()
        words = pc.list_flatten(parts := pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column(1), "")), pattern="[^a-z]+"))
        rows = pc.list_parent_indices(parts)
        long = pc.greater_equal(pc.binary_length(words), 2)
        words, rows = words.filter(long).dictionary_encode(), rows.filter(long).to_numpy(zero_copy_only=False)
        codes = counters.codes(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.searchsorted(rows, np.arange(len(records)), side="right").tolist()
        start = 0
        for record, end in zip(records, ends):
            if not names or names[-1] != record:
                names.append(record)
            if end > start:
                counters.see(codes[start:end], len(names) - 1)
            start = end
        if len(counters.number) > flush_terms or len(names) > flush_terms:
            yield counters.rows(names)
            counters, names = Counters(), []
    if counters.number:
        yield counters.rows(names)


def term_frequencies(
    records: DataFrame, record: str, texts: list[str], unique: bool = True, flush_terms: int = 1_000_000
) -> DataFrame:
    """``term, occurrences, records`` over all ``texts`` of all ``records``.

    A term is a longest run of two or more letters A-Z, a-z, lower-cased. ``unique`` says that each
    non-null record is one row; otherwise rows are put in order of record by ranges, which cut a record
    with very many rows. Null and empty texts have no terms; rows without record, and those whose record is
    the empty string, are one record. An empty table gives no row. ``flush_terms`` bounds the counters and
    the record names that a task holds: beyond it they are passed on and started again, without loss.
    """
    # a line end between two texts of a row keeps their words apart
    rows = records.select(F.col(record).cast("string").alias("record"), F.concat_ws("\n", *[F.col(t) for t in texts]).alias("text"))
    if not unique:
        rows = rows.withColumn("record", F.coalesce("record", F.lit("")))
        rows = rows.withColumn("spread", F.xxhash64(*rows.columns)).repartitionByRange("record", "spread").sortWithinPartitions("record").drop("spread")
    counted = rows.mapInArrow(lambda batches: last_seen_counters(batches, flush_terms), OUT)
    if not unique:  # a record on one row is in one counter only
        ordered = W.partitionBy("term").orderBy("first_record", "last_record")
        again = F.coalesce((F.lag("last_record").over(ordered) == F.col("first_record")).cast("long"), F.lit(0))
        counted = counted.withColumn("records", F.col("records") - again)
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def with_marks(frequencies: DataFrame, n_records, rare_below: int = 3, common_percent: int = 30) -> DataFrame:
    """Add ``mark``: rare (in fewer than ``rare_below`` records), common (in more than ``common_percent``
    percent of ``n_records``), else null. A term that is both, as in a tiny collection, is rare."""
    return frequencies.withColumn(
        "mark",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > n_records * common_percent, "common"),
    )
