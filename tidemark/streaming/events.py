"""Streams of events: windows, duplicates, state per key, delayed labels.

Event time comes from the data. Batch and stream give the same result on the same events, except for
rows that come later than a watermark allows, which a stream drops.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import scratch


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table (one file or a folder of files) as a stream; zone-less timestamps become session timestamps."""
    path = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    is_folder = any(f.endswith(".parquet") for f in _list(spark, path))
    df = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def _list(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result.

    append: the rows of all batches; complete: those of the last. Batches are written in the shared
    folder under their number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    root = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields])
    out = f"{root}/out"
    batches = sorted(int(n.split("=")[1]) for n in _list(spark, out) if n.startswith("batch=")) if _exists(spark, out) else []
    if not batches:
        return spark.createDataFrame([], schema)
    chosen = batches if mode == "append" else batches[-1:]
    return spark.read.schema(schema).parquet(*[f"{out}/batch={b}" for b in chosen])


def tumbling_counts(events: DataFrame, ts: str, length: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_counts(events: DataFrame, ts: str, length: str, slide: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.window(ts, length, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def without_duplicates(events: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def past_rates(events: DataFrame, key: str, order: list[str], label: str, id: str) -> DataFrame:
    """``id, key, past_n, past_bad``: what was counted for the key before each event (predict, then grow).

    Keyed state holds two counters. Within a batch the rows of a key are put in order before they count;
    batches must come in order of time.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    out = T.StructType([T.StructField(id, kinds[id]), T.StructField(key, kinds[key]), T.StructField("past_n", T.LongType()), T.StructField("past_bad", T.LongType())])

    def grow(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, bad = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        y = rows[label].fillna(0).astype("int64").to_numpy()
        before = y.cumsum() - y
        yield pd.DataFrame({id: rows[id].to_numpy(), key: k[0], "past_n": n + range_of(len(rows)), "past_bad": bad + before})
        state.update((int(n + len(rows)), int(bad + y.sum())))

    return events.select(id, key, *[o for o in order if o not in (id, key)], label).groupBy(key).applyInPandasWithState(grow, out, "n long, bad long", "append", GroupStateTimeout.NoTimeout)


def range_of(n: int):
    import numpy as np

    return np.arange(n, dtype="int64")


def delayed_labels(events: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str, delay: str, within: str) -> DataFrame:
    """Events with the labels that come for them ``within`` a time; both sides wait ``delay`` for late rows."""
    e = events.withWatermark(ts, delay)
    y = labels.withColumnRenamed(key, "label_key").withWatermark(label_ts, delay)
    bound = F.expr(f"`{key}` = label_key AND `{label_ts}` >= `{ts}` AND `{label_ts}` <= `{ts}` + INTERVAL {within}")
    return e.join(y, bound)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """Keep the latest row per key of a stream in a table; returns the query.

    Each batch is reduced to one row per key and merged with the table, which is rewritten under a new
    version and then pointed to; a batch that is run again gives the same table.
    """
    from tidemark.operators.latest import latest_rows

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        versions = sorted(int(n.split("=")[1]) for n in _list(spark, path) if n.startswith("version=")) if _exists(spark, path) else []
        old = [v for v in versions if v < number]
        rows = batch if not old else batch.unionByName(spark.read.parquet(f"{path}/version={old[-1]}"))
        latest_rows(rows, key, order, rest).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    last = max(int(n.split("=")[1]) for n in _list(spark, path) if n.startswith("version="))
    return spark.read.parquet(f"{path}/version={last}")
