"""Linear models along a stream, all blocks at once.

The prequential protocol fits a model per block on everything before the block. Here the models of all
blocks are fitted together: a row belongs to the training part of every later block. Rows of up to ``CELLS`` numbers are sent to the
tasks, each of which fits the models of its blocks to the end. Of larger streams one pass gives each model's
gradient and Hessian, and a handful of Newton steps fit them all; a pass reads each row once and adds up per model on the
map side, and the driver holds the weights. With the number of blocks bounded (:class:`tidemark.spec.Protocol`)
the work grows in proportion to the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import dealt
from tidemark.session import durable

ROWS = 2048
#: Numbers of the training rows that are sent to every task.
CELLS = 20_000_000
#: Subsets of the columns from which on the products of all pairs of columns are formed once for all.
MANY = 8


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their feature matrix, which starts with a column of ones; the last column has the features."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield batch, np.hstack([np.ones((len(x), 1)), x])


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _derivatives(w: np.ndarray, of: np.ndarray, class_weight: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per model of weights ``w`` (models x features) the gradient and Hessian over the rows (y, slot, features) of its past."""
    models, d = w.shape
    g, h = np.zeros((models, d)), np.zeros((models, d * d))
    for batch, x in _pieces(batches):
        y, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        p = _probability(x @ w.T)
        weight = np.where(slot[:, None] <= of[None, :], np.where(y[:, None] == 1, class_weight[:, 1], class_weight[:, 0]), 0.0)
        g += ((y[:, None] - p) * weight).T @ x
        h += (p * (1 - p) * weight).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    yield pa.record_batch([pa.array(np.arange(models), pa.int64()), pa.array(list(np.hstack([g, h])), pa.list_(pa.float64()))], names=["model", "v"])


def _ridge_step(theta: np.ndarray, g: np.ndarray, h: np.ndarray, inverse: float, on: np.ndarray) -> np.ndarray:
    penalty = np.r_[0.0, np.ones(theta.shape[1] - 1)]
    a = inverse * h + np.diag(penalty + 1e-9)
    b = (inverse * g - penalty * theta) * on
    both = on[:, :, None] * on[:, None, :]
    a = np.where(both > 0, a, np.eye(a.shape[1]))
    return np.linalg.solve(a, b[:, :, None])[:, :, 0]


def _lasso_step(theta: np.ndarray, g: np.ndarray, h: np.ndarray, inverse: float, on: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Step of each model to the optimum of its quadratic model; the intercept has no penalty."""
    penalty = np.r_[0.0, np.full(theta.shape[1] - 1, 1 / inverse)]
    return np.stack([_lasso(theta[i], g[i], h[i], penalty, np.flatnonzero(on[i]), sweeps) for i in range(len(theta))]) - theta


def _lasso(theta: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: np.ndarray, columns: np.ndarray, sweeps: int) -> np.ndarray:
    """Coordinate descent; after each sweep the weights that are not 0 go to their joint optimum, or as far as the first that becomes 0."""
    w = theta.copy()
    c, curve = g + h @ theta, np.maximum(np.diag(h), 1e-12)
    free = penalty == 0
    for _ in range(sweeps):
        rest = c - h @ w
        for j in columns:
            to = rest[j] + curve[j] * w[j]
            to = (max(abs(to) - penalty[j], 0.0) * (1 if to > 0 else -1)) / curve[j]
            if to != w[j]:
                rest -= h[j] * (to - w[j])
                w[j] = to
        while True:
            live = np.flatnonzero((w != 0) | free)
            part = h[np.ix_(live, live)]
            move = np.linalg.solve(part + np.diag(1e-12 * np.diag(part) + 1e-12), (c - h @ w - penalty * np.sign(w))[live])
            turned = (np.sign(w[live] + move) != np.sign(w[live])) & ~free[live]
            if not turned.any():
                w[live] += move
                break
            share = np.where(turned, np.divide(-w[live], move, out=np.ones(len(live)), where=move != 0), np.inf)
            w[live] += share.min() * move
            w[live[np.argmin(share)]] = 0.0
        off = np.abs(c - h @ w) - penalty
        if (off[columns] <= 1e-9 * (1 + np.abs(c[columns]))).all():
            break
    return w


def _moments(x: np.ndarray, y: np.ndarray, raw: np.ndarray, class_weight: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of models (models x features) over the same rows; of a Hessian what ``on`` has."""
    models, d = raw.shape
    g, h = np.zeros((models, d)), np.zeros((models, d, d))
    upper = np.triu_indices(d)
    sums = np.zeros((models, len(upper[0])))
    for lo in range(0, len(x), ROWS):
        rows = x[lo : lo + ROWS]
        p = _probability(raw @ rows.T)
        weight = class_weight[y[lo : lo + ROWS]]
        g += ((y[lo : lo + ROWS] - p) * weight) @ rows
        curve = p * (1 - p) * weight
        if models >= MANY:
            sums += curve @ (rows[:, upper[0]] * rows[:, upper[1]])
            continue
        for i in range(models):
            own = np.flatnonzero(on[i])
            part = rows[:, own]
            h[i][np.ix_(own, own)] += (part * curve[i][:, None]).T @ part
    if models >= MANY:
        h[:, upper[0], upper[1]] = sums
        h[:, upper[1], upper[0]] = sums
    return g, h


def _fit(x: np.ndarray, y: np.ndarray, ends: np.ndarray, scale: np.ndarray, on: np.ndarray, class_weight: np.ndarray, inverse: float, l1: bool, steps: int, tolerance: float) -> np.ndarray:
    """Weights of the models (cuts x subsets x features) on the rows before each cut's end, by steps until each model stands still.

    ``x`` and ``scale`` have the raw columns after a one; the weights are those of standardised columns.
    """
    k, s, d = on.shape
    theta, live = np.zeros((k, s, d)), np.ones((k, s), bool)
    for _ in range(steps):
        g, h = [], []
        for i in range(k):
            own, t = np.flatnonzero(live[i]), scale[i]
            if len(own):
                # a raw weight is 0 where the standardised one is, but the first, so the first is always on
                a, b = _moments(x[: ends[i]], y[: ends[i]], theta[i, own] @ t, class_weight[i], on[i, own])
                g.append((a @ t.T) * on[i, own])
                h.append(t @ b @ t.T)
        if not g:
            break
        step = (_lasso_step if l1 else _ridge_step)(theta[live], np.concatenate(g), np.concatenate(h), inverse, on[live])
        step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
        theta[live] += step
        live[live] = np.abs(step).max(axis=1) >= tolerance
    return theta


def prequential_linear(
    df: DataFrame,
    columns: list[str],
    first: int,
    block: int,
    gap: int = 0,
    refit_every: int = 1,
    inverse: float = 1.0,
    l1: bool = False,
    subsets: dict[str, list[str]] | None = None,
    train_from: int = 0,
    keep: tuple[str, ...] = ("id", "seq", "y"),
    steps: int = 30,
    tolerance: float = 1e-6,
) -> DataFrame:
    """``keep`` and ``score`` of every row from ``first`` on, with ``combo`` if there are ``subsets`` of the columns.

    Balanced logistic regression on standardised columns, both from the rows in [train_from, start of the block - gap)
    only; where these are fewer than two or of one class, from all up to the start of the block, and where that is no better
    the score is the mean label so far (0.5 without any). ``inverse`` is the inverse weight of the squared, or with
    ``l1`` the absolute, penalty. ``seq`` is dense from 0, ``y`` is 0 or 1. Null and NaN features count as 0. A
    constant column has no weight. An empty frame gives no row.
    """
    names = list(subsets or {"": columns})
    clean = F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    rows = durable(df.select(*keep, F.col("seq").cast("long").alias("seq_"), F.col("y").cast("double").alias("y_"), clean.alias("x_")))
    n = (rows.agg(F.max("seq_")).collect()[0][0] or -1) + 1
    starts = np.arange(first, n, block)
    out = "combo string, score double" if subsets else "score double"
    if not len(starts):
        return rows.select(*keep, *([F.lit("").alias("combo")] if subsets else []), F.lit(0.5).alias("score")).limit(0)
    model_of_block = np.arange(len(starts)) // refit_every  # by block
    fit_at = starts[::refit_every]
    d, k = len(columns), len(fit_at)

    # sums of the rows between two cuts, and of all before each cut
    sums = _prefix(rows, fit_at, fit_at - gap, train_from, d)
    wide = _prefix(rows, fit_at, fit_at, train_from, d)
    good = lambda s: (s[:, 0] >= 2) & (s[:, 1] > 0) & (s[:, 1] < s[:, 0])
    cuts = np.where(good(sums), fit_at - gap, fit_at)
    sums = np.where(good(sums)[:, None], sums, wide)
    fitted = good(sums)
    count, ones = np.maximum(sums[:, 0], 1), sums[:, 1]
    mean = sums[:, 2 : 2 + d] / count[:, None]
    sd = np.sqrt(np.maximum(sums[:, 2 + d :] / count[:, None] - mean**2, 0))
    varied = sd > 1e-9 * (1 + np.abs(mean))
    sd = np.where(varied, sd, 1.0)
    class_weight = np.stack([count / (2 * np.maximum(count - ones, 1)), count / (2 * np.maximum(ones, 1))], axis=1)
    base = np.where(wide[:, 0] > 0, wide[:, 1] / np.maximum(wide[:, 0], 1), 0.5)

    # a model per cut and subset; raw weights = theta through the model's standardisation
    s = len(names)
    of = np.repeat(np.arange(k), s)
    on = np.ones((k * s, d + 1))
    for i, chosen in enumerate((subsets or {"": columns}).values()):
        on[i::s, 1:] = np.array([c in chosen for c in columns])[None, :] & varied
    scale = np.zeros((k, d + 1, d + 1))  # standardised row = scale @ raw row
    scale[:, 0, 0] = 1.0
    scale[:, np.arange(1, d + 1), np.arange(1, d + 1)] = 1 / sd
    scale[:, 1:, 0] = -mean / sd
    theta = np.zeros((k * s, d + 1))
    # rows in order of the least cut above them take part from that model on
    order = np.argsort(cuts, kind="stable")
    rank = np.argsort(order)
    edges = cuts[order]
    slots = F.lit(0)
    train = rows.where((F.col("seq_") >= train_from) & (F.col("seq_") < int(edges[-1])))
    table = F.array(*[F.lit(int(c)) for c in edges])
    slots = F.size(F.filter(table, lambda c: c <= F.col("seq_")))
    train = durable(train.select("y_", slots.cast("long").alias("slot_"), "x_"))
    alone = train.count() * (d + 1) <= CELLS
    if fitted.any() and alone:
        theta = _fit_in_tasks(train, np.flatnonzero(fitted), rank, scale, on.reshape(k, s, d + 1), class_weight, inverse, l1, steps, tolerance).reshape(k * s, d + 1)
    for _ in range(steps if fitted.any() and not alone else 0):
        raw = np.einsum("mi,mij->mj", theta, scale[of])
        part = train.mapInArrow(lambda b, raw=raw: _derivatives(raw, rank[of], class_weight[of], b), "model long, v array<double>")
        found = part.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
        total = np.zeros((k * s, (d + 1) * (d + 2)))
        for r in found:
            total[r["model"]] = r["v"]
        t = scale[of]
        g = np.einsum("mij,mj->mi", t, total[:, : d + 1]) * on
        h = t @ total[:, d + 1 :].reshape(-1, d + 1, d + 1) @ t.transpose(0, 2, 1)
        step = (_lasso_step if l1 else _ridge_step)(theta, g, h, inverse, on)
        step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
        theta = theta + step * fitted[of][:, None]
        if np.abs(step[fitted[of]]).max() < tolerance:
            break
    raw = np.einsum("mi,mij->mj", theta, scale[of]).reshape(k, s, d + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _pieces(batches):
            seq = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            model = model_of_block[(seq - first) // block]
            p = np.where(fitted[model][:, None], _probability(np.einsum("nd,nsd->ns", x, raw[model])), base[model][:, None])
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            for i, name in enumerate(names):
                combo = [pa.array([name] * len(x), pa.string())] if subsets else []
                yield pa.record_batch([*kept, *combo, pa.array(p[:, i])], names=[*keep, *(["combo"] if subsets else []), "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.where(F.col("seq_") >= first).select(*keep, "seq_", "x_").mapInArrow(score, f"{kinds}, {out}")


def _fit_in_tasks(train: DataFrame, fitted: np.ndarray, rank: np.ndarray, scale: np.ndarray, on: np.ndarray, class_weight: np.ndarray, inverse: float, l1: bool, steps: int, tolerance: float) -> np.ndarray:
    """Weights of the models of the ``fitted`` cuts, of the others 0; ``train`` has y_, slot_ and x_."""
    spark = train.sparkSession
    t = train.toArrow()
    y, slot = (t.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(slot, kind="stable")
    ends = np.searchsorted(slot[order], rank, side="right")  # rows in the past of each cut
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, lo = np.ones((len(y), on.shape[2])), 0
    for batch in t.column(2).chunks:
        x[place[lo : lo + len(batch)], 1:] = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        lo += len(batch)
    y = y[order].astype(np.int64)
    del t
    pa.default_memory_pool().release_unused()  # the driver holds the rows once
    sent = spark.sparkContext.broadcast((x, y, scale, on, class_weight))
    del x
    tasks = [[int(fitted[i]) for i in own] for own in dealt(spark, len(fitted), len(fitted))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, scale, on, class_weight = sent.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = tasks[i]
                found = _fit(x, y, ends[own], scale[own], on[own], class_weight[own], inverse, l1, steps, tolerance)
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array(list(found.reshape(len(own), -1)), pa.list_(pa.float64()))], names=["cut", "v"])

    out = np.zeros((len(on), on[0].size))
    found = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "cut long, v array<double>").toArrow()
    out[found.column("cut").to_numpy()] = found.column("v").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    sent.destroy()
    return out


def _prefix(rows: DataFrame, at: np.ndarray, cuts: np.ndarray, train_from: int, d: int) -> np.ndarray:
    """Per cut the count, positives, sums and sums of squares of the rows in [train_from, cut)."""
    table = F.array(*[F.lit(int(c)) for c in cuts])
    slot = F.size(F.filter(table, lambda c: c <= F.col("seq_")))
    square = F.transform("x_", lambda x: x * x)
    v = array_to_vector(F.concat(F.array(F.lit(1.0), F.col("y_")), F.col("x_"), square))
    part = rows.where(F.col("seq_") >= train_from).groupBy(slot.alias("slot_")).agg(vector_to_array(Summarizer.sum(v)).alias("v")).collect()
    out = np.zeros((len(cuts) + 1, 2 + 2 * d))
    for r in part:
        out[r["slot_"]] = r["v"]
    return np.cumsum(out, axis=0)[: len(cuts)]
