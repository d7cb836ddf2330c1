"""Evaluation of a score stream: ranking metrics, operating points, effort, trajectories, roll-ups.

A score stream has a position (seq), a label (0 or 1) and a score. Everything that needs an order of
scores works on distinct scores with their counts (see :func:`tidemark.operators.stats.value_table`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.past import recent_past, strict_past, with_sequence
from tidemark.operators.stats import quantiles, value_table


def scrub(score: Column, fill: Column | float = 0.5) -> Column:
    """Null and NaN as ``fill``, infinities and drift clipped to [0, 1]."""
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(score, fill), fill)))


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc, n1, n0`` by midranks; null where a class is missing."""
    t = value_table(df.where(F.col(label).isin(0, 1)), score, {"ones": F.col(label).cast("long")})
    zeros = F.col("n") - F.col("ones")
    zeros_below = F.col("n_below") - F.col("ones_below")
    s = t.agg(F.sum(F.col("ones") * (zeros_below + zeros / 2)).alias("u"), F.sum("ones").alias("n1"), F.sum(zeros).alias("n0"))
    return s.select(F.try_divide("u", F.col("n1") * F.col("n0")).alias("auc"), "n1", "n0")


def cut_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score the true and false positives when it is the threshold, with recall, precision and F1."""
    t = value_table(df.where(F.col(label).isin(0, 1)), score, {"ones": F.col(label).cast("long")})
    total = t.agg(F.sum("n").alias("all_n"), F.sum("ones").alias("all_ones"))
    t = t.crossJoin(F.broadcast(total))  # one row
    tp = F.col("all_ones") - F.col("ones_below")
    pp = F.col("all_n") - F.col("n_below")
    return t.select(
        F.col(score).alias("threshold"), "n", "ones", tp.alias("tp"), (pp - tp).alias("fp"), "all_ones", "all_n",
        safe(tp, pp).alias("precision"), safe(tp, F.col("all_ones")).alias("recall"), safe(2 * tp, pp + F.col("all_ones")).alias("f1"),
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    c = cut_points(df, score, label)
    return c.agg(F.sum(F.try_divide("ones", "all_ones") * F.col("precision")).alias("average_precision"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of greatest F1, the highest of equal ones; 0.5 where a class is missing."""
    c = cut_points(df, score, label).agg(F.max(F.struct("f1", "threshold")).alias("b"), F.max("all_ones").alias("p"), F.max("all_n").alias("n"))
    one_class = (F.coalesce("p", F.lit(0)) == 0) | (F.col("p") == F.col("n"))
    return c.select(F.when(one_class, 0.5).otherwise(F.col("b.threshold")).alias("threshold"), F.when(~one_class, F.col("b.f1")).alias("f1"))


def rate_matched_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score above which lies the share of positives (linear quantile)."""
    rate = df.agg(F.avg(label)).collect()[0][0]
    return df.sparkSession.createDataFrame([(quantiles(df, score, [1 - rate if rate is not None else 0.5])[0],)], "threshold double")


def confusion(df: DataFrame, label: str, decision: str, score: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and what follows from them; with ``score`` also the Brier score."""
    y, d = F.col(label) == 1, F.col(decision) == 1
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(y & d).alias("tp"), F.count_if(~y & d).alias("fp"), F.count_if(~y & ~d).alias("tn"), F.count_if(y & ~d).alias("fn"),
        *([F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier")] if score else []),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    rec, spec = safe(tp, tp + fn), safe(tn, tn + fp)
    f1, f0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "precision": safe(tp, tp + fp), "recall": rec, "buggy_f1": f1, "macro_f1": (f1 + f0) / 2, "g_mean": F.sqrt(rec * spec),
        "accuracy": safe(tp + tn, tp + tn + fp + fn), "mcc": safe(tp * tn - fp * fn, root),
    })


def online_decisions(df: DataFrame, seq: str, score: str, label: str, init: int = 300, step: int = 150, gap: int = 0) -> DataFrame:
    """Add ``threshold`` and ``decision``: the threshold is tuned for F1 every ``step`` rows on the labels known by then.

    ``seq`` is dense from 0. Before row ``init``, and while the known labels are of one class, the
    threshold is 0.5 or the last tuned one. Labels of the last ``gap`` rows are not known. Each distinct
    score enters a checkpoint as one row of counts, and the checkpoints are tuned side by side.
    """
    last = df.agg(F.max(seq)).collect()[0][0]
    if last is None:
        return df.withColumn("threshold", F.lit(0.5)).withColumn("decision", F.lit(0))
    first_end = -(-max(init, gap + 2, step) // step) * step
    # counts per score and step of the stream; each goes into all later checkpoints
    slot = F.floor((F.col(seq) + gap) / step)
    per = df.select(seq, F.col(score).alias("s"), F.col(label).alias("y")).groupBy(slot.alias("slot"), "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    begin = F.greatest((F.col("slot") + 1) * step, F.lit(first_end).cast("long"))
    known = per.where(begin <= last).withColumn("at", F.explode(F.sequence(begin, F.greatest(begin, F.lit(last).cast("long")), F.lit(step).cast("long"))))
    known = known.groupBy("at", "s").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    w = W.partitionBy("at").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("at")
    cut = known.withColumns({"pp": F.sum("n").over(w), "tp": F.sum("ones").over(w), "p": F.sum("ones").over(whole), "all": F.sum("n").over(whole)})
    best = cut.where("p > 0 AND p < all").groupBy((F.col("at") / step).cast("long").alias("slot_")).agg(F.max(F.struct(safe(2 * F.col("tp"), F.col("pp") + F.col("p")).alias("f"), "s")).getField("s").alias("tuned"))
    slots = df.sparkSession.range(0, last // step + 1).withColumnRenamed("id", "slot_").join(best, "slot_", "left")
    held = F.when(F.col("tuned").isNotNull(), F.struct("slot_", "tuned"))
    filled = strict_past(slots, [], "slot_", {"held": ("max", held)}, inclusive=True).select("slot_", F.coalesce("held.tuned", F.lit(0.5)).alias("threshold"))
    out = df.withColumn("slot_", F.floor(F.col(seq) / step)).join(filled, "slot_", "left").drop("slot_")
    return out.withColumn("decision", (F.col(score) >= F.col("threshold")).cast("int"))


def trajectory(df: DataFrame, seq: str, label: str, decision: str, roll: int = 150, stride: int = 25) -> DataFrame:
    """Rolling metrics over the last ``roll`` rows, at every ``stride``-th row."""
    y, d = F.col(label) == 1, F.col(decision) == 1
    counts = recent_past(df, seq, roll, {"tp": F.count_if(y & d), "fp": F.count_if(~y & d), "tn": F.count_if(~y & ~d), "fn": F.count_if(y & ~d)}, inclusive=True)
    at = counts.where((F.col(seq) + 1) % stride == 0)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    rec, spec = safe(tp, tp + fn), safe(tn, tn + fp)
    f1, f0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    return at.select(
        (F.col(seq) + 1).alias("position"), safe(tp, tp + fp).alias("precision"), rec.alias("recall"), f1.alias("buggy_f1"), ((f1 + f0) / 2).alias("macro_f1"),
        F.sqrt(rec * spec).alias("g_mean"), safe(tp + tn, tp + fp + tn + fn).alias("accuracy"), safe(tp + fn, tp + fp + tn + fn).alias("bug_rate"),
    )


def rolling_auc(df: DataFrame, seq: str, label: str, score: str, roll: int = 150, stride: int = 25) -> DataFrame:
    """AUC over the last ``roll`` rows at every ``stride``-th row; null where a class is missing.

    Every row goes to the at most roll / stride + 1 windows it is in, and each window is ranked by itself.
    """
    last = df.agg(F.max(seq)).scalar()
    first = (F.floor(F.col(seq) / stride) + 1) * stride
    rows = df.select(seq, F.col(label).alias("y"), F.col(score).alias("s")).withColumn("position", F.explode(F.sequence(first, first + (roll // stride) * stride, F.lit(stride))))
    rows = rows.where((F.col("position") - F.col(seq) <= roll) & (F.col("position") <= last + 1))
    w = W.partitionBy("position").orderBy("s")
    ranked = rows.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy("position", "s")) - 1) / 2)
    n1, n = F.sum("y"), F.count(F.lit(1))
    return ranked.groupBy("position").agg(F.try_divide(F.sum(F.col("r") * F.col("y")) - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))


def inspected(df: DataFrame, order: list[Column], label: str, effort: str, id: str) -> DataFrame:
    """Rows in inspection order with running effort ``ce`` and bugs ``cy``; efforts below or at 0 count as 1."""
    base = df.select(id, F.col(label).cast("long").alias("y_"), F.when(F.col(effort) <= 0, 1.0).otherwise(F.col(effort).cast("double")).alias("e_"), *[c.alias(f"o{i}_") for i, c in enumerate(order)])
    placed = with_sequence(base, [*[f"o{i}_" for i in range(len(order))], id], "place_")
    return strict_past(placed, [], "place_", {"ce": ("sum", F.col("e_")), "cy": ("sum", F.col("y_"))}, inclusive=True)


def _area(curve: DataFrame) -> Column:
    """Expression: area under bugs against effort, both as shares, over the rows of ``inspected``."""
    return F.try_divide(F.sum(F.col("e_") * (2 * F.col("cy") - F.col("y_")) / 2), F.max("ce") * F.max("cy"))


def popt(df: DataFrame, label: str, score: str, effort: str, id: str) -> DataFrame:
    """``popt``: 1 for the ideal order, 0 for its reverse; null where a class is missing."""
    e = F.when(F.col(effort) <= 0, 1.0).otherwise(F.col(effort).cast("double"))
    orders = {"model": [-(F.col(score) / e), e], "best": [-F.col(label), e], "worst": [F.col(label), -e]}
    out = None
    for name, order in orders.items():
        c = inspected(df, order, label, effort, id)
        area = c.agg(_area(c).alias(name), *([F.max("cy").alias("n1_"), F.count(F.lit(1)).alias("n_")] if out is None else []))
        out = area if out is None else out.crossJoin(F.broadcast(area))  # one row each
    value = 1 - F.try_divide(F.col("best") - F.col("model"), F.col("best") - F.col("worst"))
    return out.select(F.when((F.col("n1_") > 0) & (F.col("n1_") < F.col("n_")), value).alias("popt"))


def effort_points(df: DataFrame, label: str, score: str, effort: str, id: str, share: float = 0.2) -> DataFrame:
    """``acc_at``: share of bugs found within ``share`` of the effort (at least the first row); ``effort_at``: share
    of effort until ``share`` of the bugs are found."""
    e = F.when(F.col(effort) <= 0, 1.0).otherwise(F.col(effort).cast("double"))
    c = inspected(df, [-(F.col(score) / e), e], label, effort, id)
    total = c.agg(F.max("ce").alias("all_e"), F.max("cy").alias("all_y"))
    c = c.crossJoin(F.broadcast(total))  # one row
    within = (F.col("ce") <= share * F.col("all_e")) | (F.col("place_") == 0)
    reached = F.col("cy") >= share * F.col("all_y")
    return c.agg(
        F.try_divide(F.sum(F.when(within, F.col("y_")).otherwise(0)), F.max("all_y")).alias("acc_at"),
        F.try_divide(F.min(F.when(reached, F.col("ce"))), F.max("all_e")).alias("effort_at"),
    )


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, more_than: int = 20) -> DataFrame:
    """Mean score and rate of positives per equal bin of the score with more than ``more_than`` rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate")).where(F.col("n") > more_than)


def most_confident(df: DataFrame, score: str, keep: float = 0.8) -> DataFrame:
    """The ``keep`` share of rows farthest from 0.5 (all ties at the edge included)."""
    c = F.abs(F.col(score) - 0.5)
    edge = quantiles(df.select(c.alias("c_")), "c_", [1 - keep])[0]
    return df.where(c >= F.lit(edge))


def combine(df: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Macro mean and weighted means of a metric over projects; null and NaN values take no part."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("macro"), *[F.try_divide(F.sum(F.col(w) * F.col(value)), F.sum(w)).alias(f"weighted_{w}") for w in weights]
    )


def splice(first: Column, later: Column, position: Column, switch: int) -> Column:
    """The first ``switch`` rows from one score, the rest from another."""
    return F.when(position < switch, first).otherwise(later)


def best_in_column(df: DataFrame, column: str, value: str, item: str) -> DataFrame:
    """Rank of each item per column (1 is best) and whether it is the best; ties by item."""
    w = W.partitionBy(column).orderBy(F.desc(value), item)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("is_best", (F.col(value) == F.max(value).over(W.partitionBy(column))).cast("int"))


def parsimonious(df: DataFrame, score: str, size: str, tie: str, tolerance: float = 0.005) -> DataFrame:
    """Of the rows within ``tolerance`` of the best score the one of least size, then greatest score, then tie."""
    top = df.agg(F.max(score)).scalar()
    return df.where(F.col(score) >= top - tolerance).orderBy(size, F.desc(score), tie).limit(1)


def tally(df: DataFrame, diff: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Wins, ties and losses by significance."""
    sig = F.col(p) < alpha
    return df.agg(F.count_if(sig & (F.col(diff) > 0)).alias("wins"), F.count_if(~sig | (F.col(diff) == 0)).alias("ties"), F.count_if(sig & (F.col(diff) < 0)).alias("losses"))


def init_window(df: DataFrame, seq: str, label: str, start: int, floor: int = 300, cap: int = 1000, step: int = 50, least: int = 10) -> int:
    """Rows after ``start`` until both classes have ``least`` rows, from ``floor`` in steps up to ``cap``."""
    slot = F.greatest(F.lit(0), F.ceil((F.col(seq) - start + 1 - floor) / step))
    rows = df.where((F.col(seq) >= start) & (F.col(seq) < start + cap)).groupBy(slot.alias("slot")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    pos = n = 0
    for r in sorted(rows.collect()):  # one row per step
        pos, n = pos + r["pos"], n + r["n"]
        if min(pos, n - pos) >= least:
            return min(cap, floor + r["slot"] * step)
    return cap
