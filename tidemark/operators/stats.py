"""Distribution summaries, ranks, tests and intervals.

Ranks and running sums are taken over distinct values: equal values are first added up per value on
the map side, and positions over the values are taken in blocks, so no task sorts the whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.past import strict_past, with_sequence
from tidemark.session import durable


def value_table(df: DataFrame, value: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct non-null value ``n`` and the sums, with running totals of lesser values (``*_below``)."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(n) for n, x in sums.items()])
    names = ["n", *sums]
    placed = with_sequence(per, [value], "place_")
    return strict_past(placed, [], "place_", {f"{n}_below": ("sum", F.col(n)) for n in names})


def quantiles(df: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Exact continuous quantiles (linear between neighbours) of a column; None without values.

    They are looked up by position among the distinct values and their counts, so no task holds the column.
    """
    t = durable(value_table(df, value, {}))
    n = t.agg(F.sum("n")).collect()[0][0]
    if not n:
        return [None] * len(at)
    places = [(n - 1) * q for q in at]
    ends = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    found = {r["p_"]: r["v_"] for r in t.select(F.col(value).cast("double").alias("v_"), F.explode(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: (e >= F.col("n_below")) & (e < F.col("n_below") + F.col("n")))).alias("p_")).collect()}
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, n - 1)] - found[int(p)]) for p in places]


def midranks(df: DataFrame, value: str, name: str = "midrank") -> DataFrame:
    """Add the average rank (from 1) among equal values; null for null and NaN."""
    ranks = value_table(df, value, {}).select(F.col(value).alias("value_"), (F.col("n_below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, df[value] == F.col("value_"), "left").drop("value_")


def describe(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, population sd, min, median, 95th percentile, max, sum, Gini and population skewness.

    Per combination of ``keys`` if given. Nulls and NaN are left out. Without values n is 0 and the rest
    0; a constant column has skewness 0, a sum of 0 has Gini 0. The percentiles are exact; the Gini
    index comes from counts per distinct value.
    """
    keys = keys or []
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v_"))
    per = rows.groupBy(*keys, "v_").agg(F.count(F.lit(1)).alias("c_"))
    moments = rows.groupBy(*keys).agg(
        F.count("v_").alias("n"), F.avg("v_").alias("mean"), F.stddev_pop("v_").alias("std"), F.min("v_").alias("min"), F.max("v_").alias("max"),
        F.sum("v_").alias("sum"), F.skewness("v_").alias("skew"),
    )
    ranked = durable(strict_past(with_sequence(per, [*keys, "v_"], "place_"), keys, "place_", {"b_": ("sum", F.col("c_"))}))
    # percentiles by position among the distinct values
    n_of = ranked.groupBy(*keys).agg(F.sum("c_").alias("n_"))
    sized = ranked.join(n_of, keys) if keys else ranked.crossJoin(F.broadcast(n_of))  # one row
    cuts = {}
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("n_") - 1) * q
        holds = lambda p: (F.col("b_") <= p) & (p < F.col("b_") + F.col("c_"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("v_"))), F.max(F.when(holds(F.least(F.floor(at) + 1, F.col("n_") - 1)), F.col("v_")))
        cuts[name] = low + (F.max(at) - F.floor(F.max(at))) * (high - low)
    percentiles = sized.groupBy(*keys).agg(*[x.alias(name) for name, x in cuts.items()])
    moments = moments.join(percentiles, keys) if keys else moments.crossJoin(F.broadcast(percentiles))  # one row each
    # the ranks of c equal values after b lesser ones add up to c * b + c (c + 1) / 2
    weighted = ranked.groupBy(*keys).agg(F.sum(F.col("v_") * (F.col("c_") * F.col("b_") + F.col("c_") * (F.col("c_") + 1) / 2)).alias("w_"))
    joined = moments.join(weighted, keys) if keys else moments.crossJoin(F.broadcast(weighted))  # one row each
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
    gini = F.when(F.col("sum") != 0, 2 * F.col("w_") / (F.col("n") * F.col("sum")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return joined.select(*keys, "n", *[zero(c) for c in ("mean", "std", "min", "p50", "p95", "max", "sum")], gini.alias("gini"), zero("skew"))


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Shannon entropy (natural log) of a category's shares per combination of keys; null is a category."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("c_"))
    # -sum(p ln p) = ln n - sum(c ln c) / n
    return counts.groupBy(*keys).agg((F.log(F.sum("c_")) - F.sum(F.col("c_") * F.log("c_")) / F.sum("c_")).alias("entropy"), F.sum("c_").alias("n"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, as rows (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of group 1 against group 0, by midranks, with counts, Cliff's delta and the normal two-sided p with tie correction."""
    t = value_table(df.where(F.col(group).isin(0, 1)), value, {"ones": F.col(group).cast("long")})
    mid = F.col("n_below") + (F.col("n") + 1) / 2
    s = t.agg(
        F.sum(F.col("ones") * mid).alias("r1"), F.sum("ones").alias("n1"), F.sum("n").alias("n_"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    ).withColumn("n0", F.col("n_") - F.col("n1"))
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    pairs = F.col("n1") * F.col("n0").cast("double")
    var = pairs / 12 * ((F.col("n_") + 1) - F.try_divide("ties", F.col("n_") * (F.col("n_") - 1)))
    z = F.try_divide(F.col("u") - pairs / 2, F.sqrt(var))
    return s.select("n1", "n0", "u", (F.try_divide(2 * F.col("u"), pairs) - 1).alias("cliffs_delta"), z.alias("z"), two_sided(z).alias("p"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the complementary error function's continued approximation (error below 1.2e-7)."""
    a = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * a)
    # fixed values: coefficients of the Chebyshev fit of erfc
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    erfc = t * F.exp(-a * a + poly)
    return F.when(x >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test of paired columns: n of non-zero differences, W+ and W-, z and p of the normal approximation."""
    d = df.select((F.col(a) - F.col(b)).alias("d_")).where("d_ <> 0").select(F.abs("d_").alias("m_"), (F.col("d_") > 0).cast("long").alias("up_"))
    t = value_table(d, "m_", {"up": F.col("up_")})
    mid = F.col("n_below") + (F.col("n") + 1) / 2
    s = t.agg(F.sum("n").alias("n"), F.sum(F.col("up") * mid).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * mid).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return s.select("n", "w_plus", "w_minus", z.alias("z"), two_sided(z).alias("p"))


def delong(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Paired test of two AUCs: auc_a, auc_b, z, p. Structural components come from midranks over all and within each class."""
    rows = df.where(F.col(y).isin(0, 1) & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(y).alias("y_"), F.col(a).alias("a_"), F.col(b).alias("b_"))
    out = rows
    for s in ("a_", "b_"):
        t = value_table(rows, s, {"ones": F.col("y_")})
        t = t.select(F.col(s).alias("v_"), (F.col("n_below") - F.col("ones_below") + (F.col("n") - F.col("ones")) / 2).alias(f"{s}neg"), (F.col("ones_below") + F.col("ones") / 2).alias(f"{s}pos"))
        out = out.join(t, out[s] == F.col("v_")).drop("v_")
    totals = rows.agg(F.sum("y_").alias("m_"), F.sum(1 - F.col("y_")).alias("k_"))
    out = out.crossJoin(F.broadcast(totals))  # one row
    # component of a positive: share of negatives below it; of a negative: share of positives above it
    part = lambda s: F.when(F.col("y_") == 1, F.col(f"{s}neg") / F.col("k_")).otherwise(1 - F.col(f"{s}pos") / F.col("m_"))
    out = out.select("y_", "m_", "k_", part("a_").alias("va"), part("b_").alias("vb"))
    pos, neg = F.col("y_") == 1, F.col("y_") == 0
    on = lambda c, x: F.when(c, x)
    s = out.agg(
        F.max("m_").alias("m"), F.max("k_").alias("k"), F.avg(on(pos, F.col("va"))).alias("auc_a"), F.avg(on(pos, F.col("vb"))).alias("auc_b"),
        F.var_samp(on(pos, F.col("va") - F.col("vb"))).alias("s1"), F.var_samp(on(neg, F.col("va") - F.col("vb"))).alias("s0"),
    )
    var = F.col("s1") / F.col("m") + F.col("s0") / F.col("k")
    z = F.when(var > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var)).when(F.col("auc_a") == F.col("auc_b"), 0.0)
    return s.select("auc_a", "auc_b", z.alias("z"), two_sided(z).alias("p"))


def holm(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Add ``p_holm``, adjusted step-down over all rows (a table of tests, one row each)."""
    w = W.orderBy(p, tie)
    m = df.agg(F.count(p)).scalar()
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    ranked = df.withColumn("step_", step)
    return ranked.withColumn("p_holm", F.least(F.max("step_").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))).drop("step_")


def tail_fit(df: DataFrame, value: str, xmins: list[float] | None = None) -> DataFrame:
    """Power-law tail: the xmin of least Kolmogorov-Smirnov distance, with alpha, n_tail and ks.

    Candidates are the whole parts of ten percentiles from the 50th to the 95th. Values must be
    positive; a candidate needs ten values, the column twenty, else there is no row.
    """
    rows = df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("v_"))
    if xmins is None:
        found = quantiles(rows, "v_", [0.5 + 0.05 * i for i in range(10)]) if rows.count() >= 20 else []
        xmins = sorted({float(int(q)) for q in found if int(q) >= 1})
    schema = "xmin double"
    cands = F.broadcast(df.sparkSession.createDataFrame([(float(x),) for x in xmins], schema))
    per = rows.groupBy("v_").agg(F.count(F.lit(1)).alias("c_"))
    tail = per.join(cands, F.col("v_") >= F.col("xmin"))
    fit = tail.groupBy("xmin").agg(F.sum("c_").alias("n_tail"), F.sum(F.col("c_") * F.log(F.col("v_") / (F.col("xmin") - 0.5))).alias("l_")).where("n_tail >= 10").withColumn("alpha", 1 + F.col("n_tail") / F.col("l_"))
    upto = W.partitionBy("xmin").orderBy("v_").rowsBetween(W.unboundedPreceding, 0)
    curve = tail.join(F.broadcast(fit), "xmin").withColumn("hi_", F.sum("c_").over(upto))
    law = 1 - F.pow(F.col("v_") / F.col("xmin"), 1 - F.col("alpha"))
    # the empirical curve steps over equal values: both ends of the step count
    gap = F.greatest(F.abs(F.col("hi_") / F.col("n_tail") - law), F.abs((F.col("hi_") - F.col("c_") + 1) / F.col("n_tail") - law))
    best = curve.groupBy("xmin").agg(F.max(gap).alias("ks"), F.max("alpha").alias("alpha"), F.max("n_tail").alias("n_tail"))
    return best.orderBy("ks", "xmin").limit(1)


def poisson_one(seed: Column) -> Column:
    """A Poisson(1) draw from a hash in [0, 1): the weight of a row in one bootstrap replicate."""
    # fixed values: distribution function of Poisson(1)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    out = F.lit(0)
    for s in steps:
        out = out + (seed >= s).cast("int")
    return out


def unit_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the columns, the same in every engine."""
    hexed = F.substring(F.md5(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in columns])), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / 4294967296.0


def bootstrap_means(df: DataFrame, id: str, values: list[str], replicates: int) -> DataFrame:
    """Weighted mean of each value per replicate 0..replicates-1, by Poisson weights hashed from (replicate, id).

    The rows are multiplied by the replicates inside the scan and added up on the map side, so what is
    shuffled is one row per replicate and task.
    """
    draws = df.select(id, *values, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    w = poisson_one(unit_hash(F.col("replicate").cast("string"), F.col(id).cast("string")))
    draws = draws.withColumn("w_", w)
    return draws.groupBy("replicate").agg(*[F.try_divide(F.sum(F.col("w_") * F.col(v)), F.sum("w_")).alias(v) for v in values])


def bootstrap_interval(df: DataFrame, id: str, a: str, b: str, replicates: int = 2000) -> DataFrame:
    """Paired difference of means a - b: estimate, 95 percent interval and two-sided p."""
    reps = bootstrap_means(df, id, [a, b], replicates).withColumn("d", F.col(a) - F.col(b))
    seen = df.agg((F.avg(a) - F.avg(b)).alias("diff"))
    s = reps.agg(
        F.expr("percentile(d, 0.025)").alias("lo"), F.expr("percentile(d, 0.975)").alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"),
    )
    return seen.crossJoin(F.broadcast(s))  # one row each


def ratio_of_means(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean of group 1 over mean of group 0."""
    return df.agg(F.try_divide(F.avg(F.when(F.col(group) == 1, F.col(value))), F.avg(F.when(F.col(group) == 0, F.col(value)))).alias("ratio"))


def class_mean_projection(df: DataFrame, columns: list[str], label: str, name: str = "projection") -> DataFrame:
    """Each row's dot product with the difference of the two class means."""
    means = df.agg(*[(F.avg(F.when(F.col(label) == 1, F.col(c))) - F.avg(F.when(F.col(label) == 0, F.col(c)))).alias(f"d_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(means))  # one row
    return out.withColumn(name, sum((F.col(c) * F.col(f"d_{c}") for c in columns), F.lit(0.0))).drop(*[f"d_{c}" for c in columns])
