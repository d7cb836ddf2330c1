"""Models that learn along a stream: predict a block, see its labels, refit on all of the past."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, NGram, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.online import prequential_linear
from tidemark.session import durable


def balanced_weight(df: DataFrame, label: str = "y", name: str = "weight") -> DataFrame:
    """Add class weights n / (2 n_class), from the frame itself."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).collect()[0]
    n, p = r["n"], r["p"] or 0
    w1, w0 = (n / (2 * p) if p else 1.0), (n / (2 * (n - p)) if n - p else 1.0)
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0)))


def logistic(penalty: float = 1.0, l1: bool = False, features: str = "features", iterations: int = 50) -> LogisticRegression:
    """Balanced logistic regression; ``penalty`` is the inverse of the usual C and is scaled by rows when fitted."""
    return LogisticRegression(featuresCol=features, labelCol="y", weightCol="weight", regParam=penalty, elasticNetParam=1.0 if l1 else 0.0, maxIter=iterations)


def forest(trees: int = 100, seed: int = 0, features: str = "features") -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=features, labelCol="y", weightCol="weight", numTrees=trees, maxDepth=8, seed=seed)


def boosting(rounds: int = 30, seed: int = 0, features: str = "features") -> GBTClassifier:
    return GBTClassifier(featuresCol=features, labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=3, seed=seed)


def scaled(columns: list[str], head, mean: bool = True) -> Pipeline:
    """Assemble, standardise (fitted on what the pipeline is fitted on) and classify."""
    assemble = VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="keep")
    return Pipeline(stages=[assemble, StandardScaler(inputCol="raw_features", outputCol="features", withMean=mean, withStd=True), head])


def hashed(tokens: str, head, size: int = 1 << 18) -> Pipeline:
    """Token arrays hashed to ``size`` counts with unit length, and a classifier."""
    return Pipeline(stages=[HashingTF(inputCol=tokens, outputCol="counts_", numFeatures=size), Normalizer(inputCol="counts_", outputCol="features", p=2.0), head])


def tfidf(tokens: str, head, size: int = 20_000, min_df: float = 3.0, bigrams: bool = False) -> Pipeline:
    """Vocabulary of the training rows, term weights and a classifier."""
    stages = [NGram(n=2, inputCol=tokens, outputCol="grams_")] if bigrams else []
    source = "grams_" if bigrams else tokens
    return Pipeline(stages=[*stages, CountVectorizer(inputCol=source, outputCol="counts_", vocabSize=size, minDF=min_df), IDF(inputCol="counts_", outputCol="features"), head])


def probability(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def prequential(df: DataFrame, make: Callable[[], Pipeline], first: int, block: int = 200, gap: int = 0, refit_every: int = 1, keep: Iterable[str] = ("id", "seq", "y")) -> DataFrame:
    """``keep`` and ``score`` of every event from ``first`` on.

    Block after block: rows are scored by the model of the last fit, which saw only rows before the block
    less ``gap``. Where the known labels are of one class the score is their mean (0.5 without any). The
    driver loops over blocks and holds no rows; each block is written before the next fit.
    """
    keep = list(keep)
    df = df.withColumn("y", F.col("y").cast("double"))
    last = df.agg(F.max("seq")).collect()[0][0]
    parts, model, base = [], None, 0.5
    for number, start in enumerate(range(first, (last if last is not None else -1) + 1, block)):
        if number % refit_every == 0:
            past = df.where(F.col("seq") < start - gap)
            r = past.agg(F.avg("y").alias("m"), F.min("y").alias("a"), F.max("y").alias("b")).collect()[0]
            base = 0.5 if r["m"] is None else r["m"]
            model = make().fit(balanced_weight(past)) if r["a"] is not None and r["a"] != r["b"] else None
        rows = df.where((F.col("seq") >= start) & (F.col("seq") < start + block))
        scored = probability(model.transform(rows.withColumn("weight", F.lit(1.0)))) if model else rows.withColumn("score", F.lit(base))
        parts.append(durable(scored.select(*keep, "score")))
    if not parts:
        return df.withColumn("score", F.lit(0.5)).select(*keep, "score").limit(0)
    return reduce(DataFrame.unionByName, parts)


def stacked(scores: DataFrame, columns: list[str], first: int, block: int = 200, gap: int = 50, l1: bool = True) -> DataFrame:
    """Fusion of score columns by a standardised linear head, learnt prequentially with delayed labels."""
    return prequential_linear(scores, columns, first, block, gap, inverse=0.2 if l1 else 1.0, l1=l1)


def static_split(df: DataFrame, make: Callable[[], Pipeline], share: float = 0.7) -> DataFrame:
    """Train on the first ``share`` of the stream, score the rest."""
    n = df.agg(F.max("seq")).collect()[0][0]
    cut = int(((n or 0) + 1) * share)
    model = make().fit(balanced_weight(df.where(F.col("seq") < cut).withColumn("y", F.col("y").cast("double"))))
    return probability(model.transform(df.where(F.col("seq") >= cut).withColumn("weight", F.lit(1.0)))).select("id", "seq", "y", "score")


def sgd_along(df: DataFrame, columns: list[str], first: int, block: int = 200, rate: float = 0.5, steps: int = 5) -> DataFrame:
    """Log-loss gradient steps block by block: score a block, then let its labels move the weights.

    The weights of a block depend on those of the block before, so blocks come one after the other: two jobs
    a block, one that moves the weights, on the block's rows alone. Their number is bounded by the block length the
    protocol gives. The driver holds one weight per column.
    """
    rows = durable(df.select("id", "seq", "y", F.floor(F.col("seq") / block).cast("long").alias("b_"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x_")).repartitionByRange("seq"))
    last = rows.agg(F.max("seq")).collect()[0][0]
    if last is None:
        return df.select("id", "seq", "y", F.lit(0.5).alias("score")).limit(0)
    w = np.zeros(len(columns) + 1)
    held = []
    for b in range(0, last // block + 1):
        held.append(w)
        part = rows.where(F.col("b_") == b)
        for _ in range(steps):
            margin = F.lit(float(w[0])) + sum((F.lit(float(v)) * F.get("x_", F.lit(i)) for i, v in enumerate(w[1:])), F.lit(0.0))
            err = F.col("y") - 1 / (1 + F.exp(-margin))
            g = part.agg(F.avg(err), *[F.avg(err * F.get("x_", F.lit(i))) for i in range(len(columns))]).collect()[0]
            w = w + rate * np.array([x or 0.0 for x in g])
    table = df.sparkSession.createDataFrame([(b, [float(x) for x in v]) for b, v in enumerate(held)], "b_ long, w_ array<double>")
    margin = F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), "x_"), "w_", lambda x, v: x * v), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.col("seq") >= first).join(F.broadcast(table), "b_").select("id", "seq", "y", (1 / (1 + F.exp(-margin))).alias("score"))  # one row a block


def projected(vectors: DataFrame, column: str, k: int = 2) -> DataFrame:
    """The first ``k`` principal components of an array column, up to sign."""
    from pyspark.ml.functions import array_to_vector

    df = vectors.withColumn("v_", array_to_vector(column))
    out = PCA(k=k, inputCol="v_", outputCol="p_").fit(df).transform(df)
    return out.withColumn("projection", vector_to_array("p_")).drop("v_", "p_")


def subsets(columns: list[str]) -> list[list[str]]:
    """All non-empty subsets, smaller ones first."""
    out = [[c for i, c in enumerate(columns) if b >> i & 1] for b in range(1, 1 << len(columns))]
    return sorted(out, key=lambda s: (len(s), s))


def fused_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean score of every non-empty subset of columns, as long rows (combo, n, id, y, score)."""
    rows = [F.struct(F.lit("+".join(s)).alias("combo"), F.lit(len(s)).alias("n"), (sum((F.col(c) for c in s[1:]), F.col(s[0])) / len(s)).alias("score")) for s in subsets(columns)]
    return df.select("id", "seq", "y", F.explode(F.array(*rows)).alias("c")).select("id", "seq", "y", "c.*")


def timed(name: str, run: Callable[[], DataFrame]) -> tuple[str, float, int]:
    """Seconds and rows of one evaluation, for cost profiles."""
    import time

    t = time.perf_counter()
    n = run().count()
    return name, time.perf_counter() - t, n
