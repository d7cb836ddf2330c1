"""Files in, files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABEL_COLUMNS = {
    "commit_id": "string", "project": "string", "buggy": "string", "fix": "string", "year": "string", "author_date": "string",
    **dict.fromkeys(["la", "ld", "nf", "nd", "ns", "ent", "ndev", "age", "nuc", "aexp", "arexp", "asexp"], "string"),
}
REQUIRED = ("commit_id", "project", "buggy", "author_date")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV as strings, projected to the known columns; a missing required column is an error."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"label file lacks {missing}")
    return raw.select(*[c for c in LABEL_COLUMNS if c in raw.columns])


def typed_labels(raw: DataFrame) -> DataFrame:
    """Label strings with types: True means true, numbers by way of double, what is no number is null."""
    out = raw
    for c in raw.columns:
        if c in ("buggy", "fix"):
            out = out.withColumn(c, F.trim(c) == "True")
        elif c in ("year", "author_date", "la", "ld", "nf", "nd", "ns"):
            out = out.withColumn(c, F.expr(f"try_cast(try_cast(`{c}` AS double) AS bigint)"))
        elif c not in ("commit_id", "project"):
            out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS double)"))
    return out


def metric_matrix(labels: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics with null as 0, in time order, and effort = la + ld + 1."""
    filled = labels.na.fill(0, metrics)
    return filled.withColumn("effort", F.col("la") + F.col("ld") + 1)


def read_blobs(spark: SparkSession, path: str, suffix: str = "*.java", largest: int = 600_000) -> DataFrame:
    """``path, length, text`` of the files under ``path`` up to ``largest`` bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)
    return raw.where(F.col("length") <= largest).select("path", "length", F.col("content").cast("string").alias("text"))


def blobs_at(changes: DataFrame, blobs: DataFrame, roots: list[str]) -> DataFrame:
    """The blob of each (ref, path); of several repositories (``root``) the first in ``roots`` that has it."""
    rank = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root"))
    best = blobs.withColumn("rank_", rank).where("rank_ > 0").groupBy("ref", "path").agg(F.min_by(F.struct("root", "text"), "rank_").alias("b"))
    return changes.join(best, ["ref", "path"], "left").select(*changes.columns, "b.root", "b.text")


def tree_count(trees: DataFrame, suffix: str = ".java") -> DataFrame:
    """Files with the suffix per tree (``ref``), 0 included."""
    return trees.groupBy("ref").agg(F.count_if(F.lower("path").endswith(suffix)).alias("n_files"))


def tail_rate(log: DataFrame, order: str, seconds: str, last: int = 100, total: int | None = None) -> DataFrame:
    """Mean seconds of the last rows, events per second and, with ``total``, the seconds to go."""
    tail = log.orderBy(F.desc(order)).limit(last)
    done = log.agg(F.count(F.lit(1))).scalar()
    out = tail.agg(F.avg(seconds).alias("mean_s")).withColumn("per_s", F.try_divide(F.lit(1.0), F.col("mean_s"))).withColumn("done", done)
    return out.withColumn("to_go_s", F.col("mean_s") * F.greatest(F.lit(total or 0) - F.col("done"), F.lit(0)))


def first_repository(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """For each ref the owning repository of least priority number."""
    best = owners.groupBy("ref").agg(F.min_by("root", "priority").alias("root"))
    return refs.join(best, "ref", "left")


def first_ready(snapshots: DataFrame, order: str, measure: str, least: int, among: int) -> DataFrame:
    """The first of the ``among`` earliest rows whose measure reaches ``least``."""
    head = snapshots.orderBy(order).limit(among)
    return head.where(F.col(measure) >= least).orderBy(order).limit(1)


def write_snapshot(df: DataFrame, root: str, name: str, version: str, partition_by: list[str] | None = None) -> str:
    """A versioned snapshot of a table; an existing version is replaced as a whole. Returns its path."""
    path = f"{root}/{name}/version={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """One version of a table, or all with the column ``version``."""
    return spark.read.parquet(f"{root}/{name}/version={version}") if version else spark.read.parquet(f"{root}/{name}")


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at ``path``, computed and written first if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overwrite_partition(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_long_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str]) -> None:
    """A table bucketed and sorted by its join key, so later joins on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("rn_ = 1").drop("rn_")
