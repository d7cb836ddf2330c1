"""Scores of all blocks of a stream from numbers that every task holds.

A block's walk, propagation or text prior goes over all rows before it, and it needs nothing of another block's. So the
rows are numbered, sent to the tasks once, and each task computes its blocks to the end: nothing is shuffled
between the steps. The rows are the bound, which is why callers join frames where there are more than ``ROWS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import parallelism

#: Rows (event with hub, event with term) that are sent to every task.
ROWS = 20_000_000
#: Cells of the vectors of a task's blocks, and of what is formed at once.
CELLS = 8_000_000
AT_ONCE = 1_000_000
#: Hubs of more than one in so many events are columns of dense matrices of EVENTS events.
SHARE = 32
EVENTS = 4096


def collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    t = df.select(*columns).toArrow()
    return [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns]


def numbers(rows: DataFrame, column: str, keep: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The values of ``column`` in order, and of each row ``keep`` and the value's number."""
    values = sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect())
    table = rows.sparkSession.createDataFrame(pa.table({column: pa.array(values, pa.string()), "number_": pa.array(np.arange(len(values)), pa.int32())}))
    return values, collected(rows.join(F.broadcast(table), column), *keep, "number_")  # as many rows as hubs or terms


def _runs(keys: np.ndarray, of: np.ndarray, w: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """out[key] += w x[of] of sorted keys, in pieces."""
    step = max(1, AT_ONCE // max(x.shape[1], 1))
    for lo in range(0, len(keys), step):
        k = keys[lo : lo + step]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[k[first]] += np.add.reduceat(x[of[lo : lo + step]] * w[lo : lo + step, None], first, axis=0)


class Weights:
    """Products with the matrix of weights between events and hubs."""

    def __init__(self, event: np.ndarray, hub: np.ndarray, w: np.ndarray, n_events: int, n_hubs: int):
        order = np.argsort(event, kind="stable")
        event, hub, w = event[order].astype(np.int64), hub[order].astype(np.int64), w[order]
        hot = np.bincount(hub, minlength=n_hubs) * SHARE > n_events
        self.n_events, self.n_hubs, self.hot = n_events, n_hubs, np.flatnonzero(hot)
        self.of_event, self.of_hub = np.bincount(event, w, n_events), np.bincount(hub, w, n_hubs)
        column = np.cumsum(hot) - 1
        dense = hot[hub]
        self.dense = (event[dense], column[hub[dense]], w[dense])
        self.sparse = event, hub, w = (event[~dense], hub[~dense], w[~dense])
        back = np.argsort(hub, kind="stable")
        self.by_hub = (hub[back], event[back], w[back])

    def _pieces(self, lo: int, hi: int) -> Iterator[tuple[int, int, np.ndarray]]:
        event, column, w = self.dense
        for a in range(lo, hi if len(self.hot) else lo, EVENTS):
            b = min(a + EVENTS, hi)
            rows = slice(*np.searchsorted(event, (a, b)))
            m = np.zeros((b - a, len(self.hot)))
            m[event[rows] - a, column[rows]] = w[rows]
            yield a, b, m

    def hubs(self, x: np.ndarray) -> np.ndarray:
        """Per hub the weighted sums of its events' ``x``."""
        out = np.zeros((self.n_hubs, x.shape[1]))
        _runs(*self.by_hub, x, out)
        for a, b, m in self._pieces(0, self.n_events):
            out[self.hot] += m.T @ x[a:b]
        return out

    def events(self, h: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Per event from ``lo`` to ``hi`` the weighted sums of its hubs' ``h``."""
        hi = self.n_events if hi is None else hi
        out = np.zeros((hi - lo, h.shape[1]))
        event, hub, w = self.sparse
        rows = slice(*np.searchsorted(event, (lo, hi)))
        _runs(event[rows] - lo, hub[rows], w[rows], h, out)
        for a, b, m in self._pieces(lo, hi):
            out[a - lo : b - lo] += m @ h[self.hot]
        return out


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.divide(1.0, x, out=np.zeros(len(x)), where=x > 0)[:, None]


def block_scores(m: Weights, y: np.ndarray, starts: np.ndarray, block: int, walk_steps: int, steps: int = 3, alpha: float = 0.15) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the events of each block ``rn``, ``lp`` and ``ppr`` as :func:`graph.rn_scores`, :func:`graph.propagation_blocks` and :func:`graph.ppr_blocks` define them."""
    n, k = len(y), len(starts)
    past = np.arange(n)[:, None] < starts
    label = y.astype(float)[:, None]
    bad, good = past * label, past * (1 - label)
    n_bad, n_good = bad.sum(0), good.sum(0)
    rate = n_bad / np.maximum(n_bad + n_good, 1)
    te, th = _inverse(m.of_event), _inverse(m.of_hub)
    near_bad, near_good = m.hubs(bad), m.hubs(good)
    f = np.where(past, label, rate)
    for _ in range(steps - 1):
        f = np.where(past, label, m.events(m.hubs(f) * th) * te)
    f = m.hubs(f) * th
    # a walk starts at events and goes to and fro, so after an even number of steps its mass at events is all that counts
    seeds = np.hstack([bad / np.where(n_bad > 0, n_bad, 1), good / np.where(n_good > 0, n_good, 1)])
    x = alpha * seeds if walk_steps % 2 else seeds
    for i in range(walk_steps // 2):
        h = (1 - alpha) * m.hubs(x * te) * th
        if i < walk_steps // 2 - 1:
            x = (1 - alpha) * m.events(h) + alpha * seeds
    for i, start in enumerate(starts.tolist()):
        hi = min(start + block, n)
        a, b = m.events(np.stack([near_bad[:, i], near_bad[:, i] + near_good[:, i]], axis=1), start, hi).T
        rn = np.where(b > 0, a / np.maximum(b, 1e-9), rate[i])
        lp = (m.events(f[:, i : i + 1], start, hi) * te[start:hi])[:, 0]
        ends = (1 - alpha) * m.events(h[:, [i, k + i]], start, hi) + alpha * seeds[start:hi, [i, k + i]] if walk_steps > 1 else x[start:hi, [i, k + i]]
        yield np.arange(start, hi), rn, lp, ends[:, 0] / (ends[:, 0] + ends[:, 1] + 1e-12)


def dealt(spark, n: int, most: int) -> list[list[int]]:
    """The numbers of ``n`` blocks for the tasks, at most ``most`` each; neighbours are apart, since later blocks have more rows before them."""
    tasks = max(1, min(n, max(parallelism(spark), -(-n // max(most, 1)))))
    return [list(range(t, n, tasks)) for t in range(tasks)]


def graph_blocks(events: DataFrame, graphs: dict[str, DataFrame], n: int, starts: list[int], block: int, walk_steps: int) -> DataFrame:
    """``seq`` and per graph rn, lp and ppr of the events of every block; and of all graphs together, as ``full``.

    ``events`` has (seq, y) with dense seq, each of ``graphs`` distinct (seq, hub, tf). A weight is tf ln(1 + n / events of the hub).
    """
    spark = events.sparkSession
    seq, y = collected(events, "seq", "y")
    label = np.zeros(n, np.int8)
    label[seq] = y
    parts, width = {}, 0
    for name, rows in graphs.items():
        hubs, (event, tf, hub) = numbers(rows, "hub", ["seq", "tf"])
        w = tf * np.log(1 + n / np.maximum(np.bincount(hub, minlength=len(hubs)), 1))[hub]
        parts[name] = (event.astype(np.int32), (hub + width).astype(np.int32), w)
        width += len(hubs)
    names = [*graphs, "full"]
    tasks = dealt(spark, len(starts), CELLS // (2 * max(n, 1)))
    sent = spark.sparkContext.broadcast((label, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts = sent.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own, columns = np.array([starts[i] for i in tasks[t]]), {}
                for name in names:
                    entries = parts[name] if name in parts else tuple(np.concatenate(x) for x in zip(*parts.values()))
                    seq, *found = (np.concatenate(x) for x in zip(*block_scores(Weights(*entries, n, width), label, own, block, walk_steps)))
                    columns |= {"seq": seq} | {f"{name}_{k}": x for k, x in zip(("rn", "lp", "ppr"), found)}
                yield pa.record_batch(list(map(pa.array, columns.values())), names=list(columns))

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, ", ".join(["seq long", *[f"{name}_{k} double" for name in names for k in ("rn", "lp", "ppr")]]))


@dataclass
class Texts:
    """Distinct terms of events in order of events, by number: those of event i are from ``at[i]`` to ``at[i + 1]``."""

    at: np.ndarray
    term: np.ndarray
    n_terms: int

    def pairs(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """a n_terms + b of the pairs a < b of each event from ``lo`` to ``hi``, in pieces of whole events."""
        load = np.cumsum(np.diff(self.at[lo : hi + 1]) ** 2) // AT_ONCE
        for a, b in zip(cuts := [lo, *(np.flatnonzero(np.diff(load)) + lo + 1).tolist(), hi], cuts[1:]):
            lens = np.diff(self.at[a : b + 1])
            terms = self.term[self.at[a] : self.at[b]].astype(np.int64)
            rest = np.repeat(np.cumsum(lens), lens) - np.arange(len(terms)) - 1  # later terms of the same event
            first = np.repeat(np.arange(len(terms)), rest)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(rest) - rest, rest)
            yield terms[first] * self.n_terms + terms[second]


def _added(keys: np.ndarray, counts: np.ndarray, new: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    for piece in new:
        more, c = np.unique(piece, return_counts=True)
        at = np.searchsorted(keys, more)
        known = at < len(keys)
        known[known] = keys[at[known]] == more[known]
        counts[at[known]] += c[known]
        if not known.all():
            keys, counts = np.insert(keys, at[~known], more[~known]), np.insert(counts, at[~known], c[~known])
    return keys, counts


def text_blocks(texts: Texts, y: np.ndarray, starts: list[int], block: int, least_together: int, least_npmi: float, iterations: int, damp: float, m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Events and priors of rising blocks; see :func:`textgraph.online_prior`."""
    n, v = len(y), texts.n_terms
    bad, seen = np.zeros(v), np.zeros(v)
    keys, counts, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for start in starts:
        own = texts.term[texts.at[done] : texts.at[start]]
        bad += np.bincount(own, np.repeat(y[done:start], np.diff(texts.at[done : start + 1])), v)
        seen += np.bincount(own, minlength=v)
        keys, counts = _added(keys, counts, texts.pairs(done, start))
        done, hi = start, min(start + block, n)
        if not start:
            continue
        rate = y[:start].sum() / start
        often = counts >= least_together
        a, b = np.divmod(keys[often], v)
        c, docs = counts[often].astype(float), float(start)
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.where(c == docs, 1.0, np.log(c * docs / (seen[a] * seen[b])) / -np.log(c / docs))
        near = npmi >= least_npmi
        a, b, w = np.r_[a[near], b[near]], np.r_[b[near], a[near]], np.r_[npmi[near], npmi[near]]
        total, linked = np.bincount(a, w, v), np.bincount(a, minlength=v) > 0
        p = w / total[a]
        base = np.where(seen > 0, (bad + m * rate) / (seen + m), rate)  # a new term has the rate
        risk = base
        for _ in range(iterations):
            risk = np.where(linked, (1 - damp) * base + damp * np.bincount(a, p * risk[b], v), base)
        lens = np.diff(texts.at[start : hi + 1])
        sums = np.bincount(np.repeat(np.arange(hi - start), lens), risk[texts.term[texts.at[start] : texts.at[hi]]], hi - start)
        yield np.arange(start, hi), np.where(lens > 0, sums / np.maximum(lens, 1), rate)


def prior_blocks(event_terms: DataFrame, events: DataFrame, n: int, starts: list[int], block: int, **how) -> DataFrame:
    """``seq, prior`` of the events of every block; ``event_terms`` has distinct (seq, term), ``events`` (seq, y) with dense seq."""
    spark = events.sparkSession
    seq, y = collected(events, "seq", "y")
    label = np.zeros(n, np.int64)
    label[seq] = y
    terms, (event, term) = numbers(event_terms, "term", ["seq"])
    order = np.lexsort((term, event))
    sent = spark.sparkContext.broadcast((Texts(np.searchsorted(event[order], np.arange(n + 1)), term[order].astype(np.int32), max(len(terms), 1)), label))
    tasks = max(1, min(len(starts), spark.sparkContext.defaultParallelism))  # each counts the pairs before its first block
    first = [round(len(starts) * (t / tasks) ** 0.5) for t in range(tasks + 1)]  # fewer blocks for those that count more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label = sent.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for seq, prior in text_blocks(texts, label, starts[first[t] : first[t + 1]], block, **how):
                    yield pa.record_batch([pa.array(seq), pa.array(prior)], names=["seq", "prior"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "seq long, prior double")
