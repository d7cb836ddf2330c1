"""Mixing sources to target shares of tokens, by entropy balancing.

Every document gets a rate, the number of copies wanted of it. Among all rates that meet the token
constraints (one per source, further ones per value of margin columns) and stay under the cap, the
operator takes those nearest to one copy of each document in the sense of entropy: they minimise the sum of
r log r - r. Their form is exponentially tilted, rate = min(cap, exp(n * sum of the multipliers of the document's
constraints)) for a document of n tokens. ``per_token`` counts entropy per token instead (the sum of n (r log r -
r)): then a rate is min(cap, exp(sum of multipliers)) and length decides nothing within a source.

The multipliers solve the convex dual by Newton's method: first of the sources, whose equations are separate and
whose steps are kept between bounds, then of all constraints, damped wherever a step would not lower the dual.
Documents alike in source, margins and tokens have one rate, so iterations read a table of their counts;
value, gradient and Hessian of each iteration are sums that Spark takes, one row per combination of
constraints. Rates are then rounded to copies: a document gets the whole part, and one more if a number
hashed from its id lies under the fraction, shifted per source so that the tokens of the copies meet the target.
Multipliers, caps and shifts are tables joined by source; the driver holds a few numbers per listed source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-split of this byte-level BPE (fixed value of the public tokenizer).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 2048
BROADCAST_SOURCES = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        n = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in texts]
        names = batch.schema.names[:-1]
        yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*names, "n_tokens"])


def token_counts(documents: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of every row; whole texts, 0 for a null text.

    ``tokenizer`` is a path that every executor can read.
    """
    rows = documents.select(*keep, F.col(text).alias("text_to_count_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda batches: _count(tokenizer, batches), f"{kinds}, n_tokens long")


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, outer spaces dropped, inner spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


@dataclass
class Plan:
    """Wanted tokens and cap per source, multipliers by (column, value), and how well the constraints are met.

    ``gradient`` is the greatest deviation from a constraint as a share of the total.
    """

    total: float = 0.0
    wanted: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    cap: dict[str, int] = field(default_factory=dict)
    multipliers: dict[tuple[str, str], float] = field(default_factory=dict)
    margins: tuple[str, ...] = ()
    iterations: int = 0
    gradient: float = 0.0
    per_token: bool = False


def _small(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of the driver, broadcast if it is small; it comes as Arrow, which needs no job."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    df = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema), ddl)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def _exponents(df: DataFrame, caps: dict[str, int], multipliers: dict[tuple[str, str], float], margins: tuple[str, ...], per_token: bool) -> DataFrame:
    """Add ``e_``, the exponent of each row's rate, and ``c_``, the logarithm of its cap; rows of other sources are left out."""
    spark = df.sparkSession
    m = sum((F.col(f"m{i}_") for i, _ in enumerate(margins)), F.col("m_"))
    out = df.join(_small(spark, [(s, float(np.log(c)), multipliers["source", s]) for s, c in caps.items()], "source string, c_ double, m_ double"), "source")
    for i, column in enumerate(margins):
        own = [(v, x) for (c, v), x in multipliers.items() if c == column]
        out = out.join(_small(spark, own, f"`{column}` string, m{i}_ double"), column)
    drop = ["m_", *(f"m{i}_" for i, _ in enumerate(margins))]
    return out.withColumn("e_", m if per_token else m * F.col("n_tokens")).drop(*drop)


def with_rates(counted: DataFrame, plan: Plan) -> DataFrame:
    """``counted`` with ``rate``; 0 for rows of other sources or margin values."""
    if not plan.cap:
        return counted.withColumn("rate", F.lit(0.0))
    keys = ["source", *plan.margins]
    tilted = _exponents(counted, plan.cap, plan.multipliers, plan.margins, plan.per_token)
    rest = counted
    for c in keys:
        names = [(v,) for col, v in plan.multipliers if col == c]
        rest = rest.join(_small(counted.sparkSession, names, f"`{c}` string").withColumn(f"has_{c}", F.lit(1)), c, "left")
    rest = rest.where(" OR ".join(f"`has_{c}` IS NULL" for c in keys)).select(*counted.columns, F.lit(0.0).alias("rate"))
    return tilted.select(*counted.columns, F.exp(F.least("e_", "c_")).alias("rate")).unionByName(rest)


def _sums(cells: DataFrame, caps: dict[str, int], multipliers: dict, margins: tuple[str, ...], per_token: bool, unit: float) -> list:
    """Per combination of constraints the sums of the dual's value ``d``, gradient ``g`` and second derivative ``h``."""
    rows = _exponents(cells, caps, multipliers, margins, per_token)
    rate = F.exp(F.least("e_", "c_"))
    over = F.greatest(F.col("e_") - F.col("c_"), F.lit(0.0))
    n, k = F.col("n_tokens"), F.col("k")
    weight, slope = (n * k, F.lit(1.0)) if per_token else (k, n / F.lit(unit))
    rows = rows.withColumns({"r_": rate, "d_": weight * unit * rate * (1 + over), "g_": n * k * rate, "h_": F.when(F.col("e_") <= F.col("c_"), n * k * slope * rate).otherwise(0.0)})
    return rows.groupBy("source", *margins).agg(F.sum("d_").alias("d"), F.sum("g_").alias("g"), F.sum("h_").alias("h")).collect()


def solve(
    counted: DataFrame,
    targets: list[tuple[str, float, int]],
    margins: dict[str, dict[str, float]] | None = None,
    total_tokens: float | None = None,
    per_token: bool = False,
    fill: float = 1.0,
    tolerance: float = 1e-9,
    max_iterations: int = 200,
) -> Plan:
    """Multipliers for ``counted`` (source, n_tokens and margin columns).

    A source without tokens cannot have its share: the shares of the others grow in proportion. The
    default total is ``fill`` times the greatest at which every source reaches its share under its cap.
    ``margins`` give wanted shares by value of further columns, taken in proportion; documents of other
    values take no part. A total or margin beyond what the caps allow raises ValueError, and so does a
    system that isn't solved to ``tolerance`` (of the total) in ``max_iterations``.
    """
    margins = {c: {v: x for v, x in values.items() if x > 0} for c, values in (margins or {}).items()}
    columns = tuple(margins)
    spark = counted.sparkSession
    listed = counted.where("n_tokens > 0").join(_small(spark, [(s,) for s, x, c in targets if x and c], "source string"), "source", "left_semi")
    for c, values in margins.items():
        listed = listed.join(_small(spark, [(v,) for v in values], f"`{c}` string"), c, "left_semi")
    cells = durable(listed.groupBy("source", *columns, "n_tokens").agg(F.count(F.lit(1)).alias("k")))
    tokens = cells.groupBy("source", *columns).agg(F.sum(F.col("n_tokens") * F.col("k")).alias("n"), F.sum("k").alias("k")).collect()
    have: dict[str, float] = {}
    for r in tokens:
        have[r["source"]] = have.get(r["source"], 0) + r["n"]
    live = {s: (x, c) for s, x, c in targets if have.get(s, 0) > 0 and x and c}
    if not live:
        return Plan(margins=columns, per_token=per_token)
    whole = sum(x for x, _ in live.values())
    share, cap = {s: x / whole for s, (x, _) in live.items()}, {s: c for s, (_, c) in live.items()}
    greatest = min(cap[s] * have[s] / share[s] for s in live)
    total = float(total_tokens or fill * greatest)
    if total > greatest * (1 + 1e-12):
        raise ValueError(f"{total:.0f} tokens wanted, but the shares and caps allow {greatest:.0f} at most")
    goal = {("source", s): x * total for s, x in share.items()}
    for c, values in margins.items():
        all_ = sum(values.values())
        for v, x in values.items():
            room = sum(r["n"] * cap[r["source"]] for r in tokens if r[c] == v)
            if x / all_ * total > room * (1 + 1e-12):
                raise ValueError(f"{c} = {v}: {x / all_ * total:.0f} tokens wanted, but the caps allow {room:.0f}")
            goal[c, v] = x / all_ * total
    names = list(goal)
    index = {k: i for i, k in enumerate(names)}
    wanted, n_sources = np.array([goal[k] for k in names]), len(share)
    # the last value of a margin follows from the others; its multiplier stays 0
    fixed = np.array([index[c, list(values)[-1]] for c, values in margins.items()], dtype=int)
    unit = 1.0 if per_token else sum(r["n"] for r in tokens) / sum(r["k"] for r in tokens)
    scale = 1.0 if per_token else 1 / unit

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Value, gradient and the blocks of the Hessian: sources, sources with margins, margins."""
        rows = _sums(cells, cap, dict(zip(names, (m * scale).tolist())), columns, per_token, unit)
        place = np.array([[index["source", r["source"]], *(index[c, r[c]] for c in columns)] for r in rows])
        g, h = np.array([r["g"] for r in rows]), np.array([r["h"] for r in rows])
        gradient, own = -wanted, np.zeros(n_sources)
        np.add.at(own, place[:, 0], h)
        cross, inner = np.zeros((n_sources, len(names) - n_sources)), np.zeros((len(names) - n_sources,) * 2)
        for a in range(place.shape[1]):
            np.add.at(gradient, place[:, a], g)
            if a:
                np.add.at(cross, (place[:, 0], place[:, a] - n_sources), h)
                for b in range(1, place.shape[1]):
                    np.add.at(inner, (place[:, a] - n_sources, place[:, b] - n_sources), h)
        gradient[fixed] = 0.0
        return sum(r["d"] for r in rows) - float(wanted @ m), gradient, own, cross, inner

    done = lambda now: np.abs(now[1]).max() <= tolerance * total
    m, tries = np.zeros(len(names)), 0
    # sources alone: each has an equation of its own, solved by Newton steps kept between two bounds
    low, high, reach = np.full(n_sources, -np.inf), np.full(n_sources, np.inf), np.ones(n_sources)
    while tries < max_iterations:
        now = at(m)
        g, h = now[1][:n_sources], now[2]
        if np.abs(g).max() <= tolerance * total:
            break
        tries += 1
        own = m[:n_sources]
        high, low = np.where(g > 0, np.minimum(high, own), high), np.where(g < 0, np.maximum(low, own), low)
        with np.errstate(invalid="ignore"):
            free = np.where(np.isinf(low), high - reach, np.where(np.isinf(high), low + reach, (low + high) / 2))
        reach = np.where(np.isinf(low) | np.isinf(high), reach * 2, reach)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = own - g / h
        m[:n_sources] = np.where(np.abs(g) <= tolerance * total / 2, own, np.where((newton > low) & (newton < high) & (np.abs(newton - own) <= reach), newton, free))
    # all constraints together
    damping = 0.0
    while columns and not done(now) and tries < max_iterations:
        tries += 1
        step = np.clip(_newton_step(now, damping, fixed - n_sources, total), -4.0, 4.0)
        trial = at(m - step)
        if trial[0] <= now[0] + 1e-12 * abs(now[0]) or np.abs(trial[1]).max() < np.abs(now[1]).max():
            m, now, damping = m - step, trial, damping / 8 if damping > 1e-6 else 0.0
        else:
            damping = max(damping * 8, 1e-3)
    if not done(now):
        raise ValueError(f"not solved in {max_iterations} iterations; greatest deviation {np.abs(now[1]).max() / total:.2e} of the total")
    return Plan(total, {s: x * total for s, x in share.items()}, share, cap, dict(zip(names, (m * scale).tolist())), columns, tries, float(np.abs(now[1]).max() / total), per_token)


def _newton_step(now: tuple, damping: float, fixed: np.ndarray, total: float) -> np.ndarray:
    """Solve Hessian times step = gradient. Sources never share a document, so their block is a diagonal and drops out first."""
    _, gradient, own, cross, inner = now
    k = len(own)
    own = own * (1 + damping) + 1e-12 * total
    if not inner.size:
        return gradient / own
    inner = inner + np.diag(np.diag(inner)) * damping + np.eye(len(inner)) * 1e-12 * total
    inner[fixed, :] = inner[:, fixed] = 0.0
    inner[fixed, fixed] = 1.0
    cross = cross.copy()
    cross[:, fixed] = 0.0
    schur = inner - cross.T @ (cross / own[:, None])
    rest = np.linalg.lstsq(schur, gradient[k:] - cross.T @ (gradient[:k] / own), rcond=None)[0]
    return np.r_[(gradient[:k] - cross @ rest) / own, rest]


def mix(
    documents: DataFrame,
    targets: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    margins: dict[str, dict[str, float]] | None = None,
    total_tokens: float | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 0,
    per_token: bool = False,
    fill: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has ``doc_id, source, n_tokens, rate, copies`` for every document of a listed source, also
    those with 0 copies; ``copies`` never exceeds the source's max_repeats. The report has, per row of
    ``targets`` (source, target_share, max_repeats), the documents and tokens there are, the wanted and
    reached tokens, documents, copies and share, and of the solution the source's multiplier per token, the Newton
    iterations and the gradient left (greatest deviation from a constraint as a share of the total). Sources are
    compared in one spelling; documents of unlisted or null sources take no part. Of a source listed twice
    the row with the greater share holds. Null and empty texts have no tokens and are never copied. Empty
    tables give empty results, and sources that have no document have null tokens wanted and share 0 reached.
    Constraints that cannot be met raise ValueError (see :func:`solve`).
    """
    listed = listed_sources(targets)
    rows = documents.select(F.col(doc).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"), *[F.col(c).cast("string").alias(c) for c in margins or {}])
    mine = rows.join(_small(documents.sparkSession, [(s,) for s, _, _ in listed], "source string"), "source", "left_semi")
    counted = durable(token_counts(mine, ["doc_id", "source", *(margins or {})], "text", tokenizer))
    return mix_counted(counted, listed, margins, total_tokens, seed, per_token, fill)


def listed_sources(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, cap) of the target table, one row a source."""
    best = F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))).alias("t")
    rows = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(best).select("source", "t.*").orderBy("source").collect()
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in rows]


def mix_counted(
    counted: DataFrame,
    listed: list[tuple[str, float, int]],
    margins: dict[str, dict[str, float]] | None = None,
    total_tokens: float | None = None,
    seed: int = 0,
    per_token: bool = False,
    fill: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """:func:`mix` of documents whose tokens are counted (doc_id, source, n_tokens and margin columns)."""
    spark = counted.sparkSession
    plan = solve(counted, listed, margins, total_tokens, per_token, fill)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rated = with_rates(counted, plan)
    # rounded, so that the order in which Spark adds up decides nothing and a rate at the cap is the cap
    rated = rated.join(_small(spark, list(plan.cap.items()), "source string, cap_ int"), "source", "left").withColumn("rate", F.round("rate", 9))
    rated = rated.withColumn("over_", F.col("rate") - F.floor("rate") - chance)
    bin_ = F.floor((F.col("over_") + 1) * (BINS / 2))
    bins = (
        rated.where("n_tokens > 0 AND rate > 0").groupBy("source", bin_.alias("bin_"))
        .agg(F.sum("n_tokens").alias("n"), F.sum(F.floor("rate") * F.col("n_tokens")).alias("whole"))
    )
    # per source at most BINS rows: the shift whose tokens come nearest to what is wanted
    falling = W.partitionBy("source").orderBy(F.desc("bin_")).rowsBetween(W.unboundedPreceding, 0)
    cut = bins.withColumns({"sum_": F.sum("n").over(falling), "whole_": F.sum("whole").over(W.partitionBy("source"))})
    options = F.array(F.struct(F.col("sum_").alias("sum_"), (F.col("bin_") * (2 / BINS) - 1).alias("edge_")), F.struct(F.lit(0).cast("long").alias("sum_"), F.lit(2.0).alias("edge_")))
    cut = cut.join(_small(spark, list(plan.wanted.items()), "source string, goal_ double"), "source").select("source", "goal_", "whole_", F.explode(options).alias("o"))
    shift = cut.groupBy("source").agg(F.min(F.struct(F.abs(F.col("o.sum_") + F.col("whole_") - F.col("goal_")).alias("off_"), F.col("o.edge_").alias("edge_"))).getField("edge_").alias("edge_"))
    rated = rated.join(F.broadcast(shift) if len(plan.cap) <= BROADCAST_SOURCES else shift, "source", "left")
    one_more = F.coalesce((bin_ * (2 / BINS) - 1 >= F.col("edge_")).cast("int"), F.lit(0))
    copies = F.when((F.col("n_tokens") > 0) & (F.col("rate") > 0), F.least(F.floor("rate").cast("int") + one_more, F.coalesce("cap_", F.lit(0)))).otherwise(0)
    mixed = rated.withColumn("copies", copies.cast("int")).select("doc_id", "source", *plan.margins, "n_tokens", "rate", "copies")
    wanted = _small(
        spark,
        [(s, x, c, plan.share.get(s), plan.wanted.get(s), plan.multipliers.get(("source", s)), plan.iterations, plan.gradient) for s, x, c in listed],
        "source string, target_share double, max_repeats int, feasible_share double, wanted_tokens double, multiplier double, iterations int, gradient double",
    )
    reached = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").alias("longest"),
        F.count_if(F.col("copies") > 0).alias("docs_used"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"),
        F.max("copies").alias("most_copies"),
    )
    report = wanted.join(reached, "source", "left").na.fill(0, ["n_docs", "n_tokens", "longest", "docs_used", "copies", "reached_tokens", "most_copies"])
    everything = report.agg(F.sum("reached_tokens").alias("all_"))
    report = report.crossJoin(F.broadcast(everything))  # one row
    return mixed, report.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", "all_"), F.lit(0.0))).drop("all_")
