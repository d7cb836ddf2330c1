"""Evaluation of the flagship score stream and statistics of its inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import past, stats
from tidemark.plans.base import METRICS, changes, events, hub_events, labels, sql
from tidemark.plans.past_queries import _PRIORS
from tidemark.session import durable, table


def _scores(spark, d):
    """(id, seq, y, project, s, t, effort): two rounded scores of every event."""
    e, hubs = hub_events(spark, d, ("la", "ld"))
    e = past.with_actor_prior(past.with_global_prior(e))
    out = past.hub_prior(hubs, e)
    s = F.round(0.5 * F.col("hub_mean") + 0.3 * F.col("actor_rate") + 0.2 * F.col("global_rate"), 6)
    effort = F.coalesce("la", F.lit(0.0)) + F.coalesce("ld", F.lit(0.0))
    return durable(out.select("id", "seq", "y", "project", s.alias("s"), F.round("actor_rate", 6).alias("t"), effort.alias("effort")))


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def roc_auc_midrank(spark, d):
    return _r(ev.roc_auc(_scores(spark, d), "s", "y"))


def average_precision(spark, d):
    return _r(ev.average_precision(_scores(spark, d), "s", "y"))


def best_f1_threshold(spark, d):
    return _r(ev.best_f1(_scores(spark, d), "s", "y"))


def rate_matched_threshold(spark, d):
    return _r(ev.rate_matched_threshold(_scores(spark, d), "s", "y"))


def confusion_metrics(spark, d):
    return _r(ev.confusion(_scores(spark, d).withColumn("d", (F.col("s") >= 0.3).cast("int")), "y", "d", "s"))


def confusion_by_project(spark, d):
    return _r(ev.confusion(_scores(spark, d).withColumn("d", (F.col("s") >= 0.3).cast("int")), "y", "d", "s", ["project"]))


def online_decisions_gap(spark, d):
    out = ev.online_decisions(_scores(spark, d), "seq", "s", "y", init=100, step=50, gap=20)
    return out.select("seq", F.round("threshold", 6).alias("threshold"), F.col("decision").cast("long").alias("decision"))


def rolling_trajectory(spark, d):
    out = _scores(spark, d).withColumn("d", (F.col("s") >= 0.3).cast("int"))
    return _r(ev.trajectory(out, "seq", "y", "d", 150, 25))


def rolling_auc(spark, d):
    return _r(ev.rolling_auc(_scores(spark, d), "seq", "y", "s", 150, 25))


def effort_popt(spark, d):
    return _r(ev.popt(_scores(spark, d), "y", "s", "effort", "id"))


def acc_at_20_effort(spark, d):
    return _r(ev.effort_points(_scores(spark, d), "y", "s", "effort", "id"))


def calibration_bins(spark, d):
    return _r(ev.calibration(_scores(spark, d), "y", "s"))


def abstention_top80(spark, d):
    return ev.most_confident(_scores(spark, d), "s").select("seq", "y", "s")


def _by_project(spark, d):
    s = _scores(spark, d).withColumn("d", (F.col("s") >= 0.3).cast("int"))
    m = ev.confusion(s, "y", "d", None, ["project"])
    return m.withColumn("n_eval", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def macro_vs_weighted(spark, d):
    m = _by_project(spark, d)
    long = m.select("project", "n_eval", F.expr("stack(3, 'precision', precision, 'recall', recall, 'accuracy', accuracy) AS (metric, value)"))
    return _r(ev.combine(long, ["metric"], "value", ["n_eval"]))


def pooled_metrics(spark, d):
    """All projects as one stream."""
    return _r(ev.confusion(_scores(spark, d).withColumn("d", (F.col("s") >= 0.3).cast("int")), "y", "d").drop("tp", "fp", "tn", "fn"))


def switch_splice(spark, d):
    return _scores(spark, d).select("seq", ev.splice(F.col("t"), F.col("s"), F.col("seq"), 200).alias("score"))


def best_switch_point(spark, d):
    """Of five switch points the one of greatest accuracy at 0.3."""
    s = _scores(spark, d)
    grid = s.select("y", "seq", "s", "t", F.explode(F.array(*[F.lit(x) for x in (0, 100, 200, 300, 400)])).alias("switch"))
    right = ((F.when(F.col("seq") < F.col("switch"), F.col("t")).otherwise(F.col("s")) >= 0.3).cast("int") == F.col("y")).cast("int")
    return _r(grid.groupBy("switch").agg(F.avg(right).alias("accuracy")).orderBy(F.desc("accuracy"), "switch").limit(1).withColumn("switch", F.col("switch").cast("long")))


def best_in_column(spark, d):
    m = _by_project(spark, d).select("project", F.expr("stack(3, 'precision', round(precision, 6), 'recall', round(recall, 6), 'accuracy', round(accuracy, 6)) AS (metric, value)"))
    out = ev.best_in_column(m, "metric", "value", "project")
    return out.select("project", "metric", "value", F.col("rank").cast("long").alias("rank"), F.col("is_best").cast("long").alias("is_best"))


def metric_pivot(spark, d):
    m = _by_project(spark, d).select("project", F.expr("stack(3, 'precision', precision, 'recall', recall, 'accuracy', accuracy) AS (metric, value)"))
    return _r(m.groupBy("project").pivot("metric", ["accuracy", "precision", "recall"]).agg(F.first("value")))


def parsimony_choice(spark, d):
    """Projects as candidates: size is n_eval, score is accuracy."""
    m = _by_project(spark, d).select("project", "n_eval", F.round("accuracy", 6).alias("accuracy"))
    return ev.parsimonious(m, "accuracy", "n_eval", "project", 0.1)


def adaptive_init(spark, d):
    n = ev.init_window(_scores(spark, d), "seq", "y", 26, 60, 400, 20, 30)
    return spark.createDataFrame([(n,)], "init long")


def scrubbed_scores(spark, d):
    """events.value as a score: nulls and excess clipped."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(ev.scrub(F.col("value") / 20)), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def eval_window(spark, d):
    s = _scores(spark, d)
    first = (s.agg(F.count(F.lit(1))).scalar() * 0.05).cast("long") + 60
    return s.where(F.col("seq") >= first).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))


# statistics


def describe_gini_skew(spark, d):
    return _r(stats.describe(labels(spark, d), "la"), 4)


def describe_by_project(spark, d):
    return _r(stats.describe(events(spark, d, metrics=("la",)), "la", ["project"]), 4)


def entropy_by_group(spark, d):
    return _r(stats.entropy(table(spark, d, "ast_nodes").where("file IS NOT NULL AND ast_type IS NOT NULL").dropDuplicates(["id"]), ["file"], "ast_type"))


def growth_by_year(spark, d):
    c = changes(spark, d).where("commit_id IS NOT NULL").groupBy("commit_id").agg(F.count(F.lit(1)).alias("delta"))
    j = events(spark, d).join(c.withColumnRenamed("commit_id", "id"), "id", "left")
    year = F.year(F.timestamp_seconds("ts")).cast("long").alias("year")
    return j.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("bug_rate"), F.coalesce(F.sum("delta"), F.lit(0)).alias("delta_sum"), F.round(F.avg("delta"), 6).alias("delta_mean"))


def op_label_composition(spark, d):
    c = changes(spark, d).where("commit_id IS NOT NULL").select(F.col("commit_id").alias("id"), "op")
    return c.join(events(spark, d).select("id", "y"), "id").groupBy("op", "y").agg(F.count(F.lit(1)).alias("n"))


def op_label_rollup(spark, d):
    c = changes(spark, d).where("commit_id IS NOT NULL").select(F.col("commit_id").alias("id"), "op")
    return c.join(events(spark, d).select("id", "y"), "id").rollup("op", "y").agg(F.count(F.lit(1)).alias("n"))


def layer_stats(spark, d):
    n = table(spark, d, "ast_nodes")
    return n.agg(F.count_distinct("id").alias("nodes"), F.count_distinct("file").alias("files"), F.count_distinct("ast_type").alias("types"), F.count_distinct("node_group").alias("groups"))


def distinct_counts(spark, d):
    c = changes(spark, d)
    return c.groupBy("op").agg(F.count_distinct("file").alias("files"), F.count_distinct("commit_id").alias("commits"), F.count_distinct("ast_type").alias("types"))


def nodes_per_file(spark, d):
    return table(spark, d, "ast_nodes").groupBy("file").agg(F.count_distinct("id").alias("n"), F.count_if("is_leaf").alias("n_leaf_rows"))


def fanout_percentiles(spark, d):
    per = changes(spark, d).where("commit_id IS NOT NULL").groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("max"), F.expr("round(percentile(n, 0.95), 6)").alias("p95"), F.expr("round(percentile(n, 0.5), 6)").alias("p50"))


def tree_statistics(spark, d):
    n = table(spark, d, "ast_nodes").where("file IS NOT NULL").dropDuplicates(["id"])
    return n.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").cast("long").alias("max_depth"), F.round(F.avg("depth"), 6).alias("mean_depth"),
        F.round(F.avg(F.col("is_leaf").cast("int")), 6).alias("leaf_ratio"), F.count_distinct("ast_type").alias("types"),
    )


def group_shares(spark, d):
    n = table(spark, d, "ast_nodes").dropDuplicates(["id"]).where("file IS NOT NULL").groupBy("file", "node_group").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("file")), 4))


def churn_ratio(spark, d):
    c = changes(spark, d)
    return c.agg(F.round(F.try_divide(F.count_if(F.col("op") == "REMOVES"), F.count_if(F.col("op") == "ADDS")), 6).alias("churn_ratio"), F.count_if(F.col("op") == "ADDS").alias("adds"))


def delta_ratio_of_means(spark, d):
    c = changes(spark, d).where("commit_id IS NOT NULL").groupBy("commit_id").agg(F.count(F.lit(1)).alias("delta"))
    j = events(spark, d).join(c.withColumnRenamed("commit_id", "id"), "id")
    return _r(stats.ratio_of_means(j, "delta", "y"))


def ols_fit(spark, d):
    return _r(stats.ols(labels(spark, d), "nf", "la"))


def metric_correlations(spark, d):
    cols = ["la", "ld", "nf", "ent", "ndev"]
    filled = labels(spark, d).na.fill(0, METRICS)
    return _r(stats.correlations(filled, cols))


def class_projection(spark, d):
    filled = events(spark, d, metrics=("la", "ld", "ent")).na.fill(0, ["la", "ld", "ent"])
    return stats.class_mean_projection(filled, ["la", "ld", "ent"], "y").select("id", F.round("projection", 4).alias("projection"))


def midranks(spark, d):
    return stats.midranks(labels(spark, d).select("commit_id", "la"), "la").select("commit_id", "midrank")


def mann_whitney(spark, d):
    return stats.mann_whitney(events(spark, d, metrics=("la",)), "la", "y").select("n1", "n0", "u", F.round("cliffs_delta", 6).alias("cliffs_delta"), F.round("z", 4).alias("z"))


def wilcoxon_ranks(spark, d):
    return stats.wilcoxon(_scores(spark, d), "s", "t").select("n", "w_plus", "w_minus", F.round("z", 4).alias("z"))


def delong_auc(spark, d):
    return stats.delong(_scores(spark, d), "y", "s", "t").select(F.round("auc_a", 6).alias("auc_a"), F.round("auc_b", 6).alias("auc_b"), F.round("z", 4).alias("z"))


def holm_adjust(spark, d):
    """Projects as tests, (1 - accuracy) as p."""
    m = _by_project(spark, d).select("project", F.round(1 - F.col("accuracy"), 6).alias("p"))
    return stats.holm(m, "p", "project").withColumn("p_holm", F.round("p_holm", 6))


def win_tie_loss(spark, d):
    m = _by_project(spark, d).select((F.col("precision") - F.col("recall")).alias("diff"), F.round(1 - F.col("accuracy"), 6).alias("p"))
    return ev.tally(m, "diff", "p", 0.3)


def bootstrap_ci(spark, d):
    s = _scores(spark, d)
    return _r(stats.bootstrap_interval(s, "id", "s", "t", 200))


def powerlaw_tail(spark, d):
    per = changes(spark, d).where("commit_id IS NOT NULL").groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.tail_fit(per, "n", [5.0, 10.0, 20.0]).select("xmin", "n_tail", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"))


def doc_frequency_idf(spark, d):
    _, hubs = hub_events(spark, d)
    n = events(spark, d).agg(F.count(F.lit(1))).scalar()
    return hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(F.log(1 + n / F.col("df")), 6))


def conditional_sums(spark, d):
    lab = labels(spark, d)
    return lab.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("buggy"), F.count_if(F.col("fix") == 1).alias("fixes"), F.round(F.avg("y"), 6).alias("rate")).withColumn("year", F.col("year").cast("long"))


def summed_layers(spark, d):
    n = table(spark, d, "ast_nodes").dropDuplicates(["id"]).withColumn("project", F.regexp_extract("file", "^([a-z]+)-", 1))
    per = n.groupBy("project", "node_group").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("node_group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("projects"))


def metric_key_union(spark, d):
    """Keys of ragged results: every (key, number of projects that have it)."""
    m = _by_project(spark, d).select("project", F.map_filter(F.create_map(F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"), F.lit("mcc"), F.col("mcc")), lambda k, v: v > 0).alias("m"))
    return m.select("project", F.explode("m").alias("metric", "v")).groupBy("metric").agg(F.count_distinct("project").alias("n_projects"))


def latency_rollup(spark, d):
    """Median per user, then mean of the medians per event type."""
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.expr("percentile(value, 0.5)").alias("m"))
    return per.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("macro_median"), F.count(F.lit(1)).alias("users"))


def seed_robustness(spark, d):
    """Mean and sample deviation of a mean over five hash-drawn samples."""
    e = labels(spark, d).where("la IS NOT NULL").select("commit_id", "la", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed"))
    kept = e.where(stats.unit_hash(F.col("seed").cast("string"), "commit_id") < 0.5).groupBy("seed").agg(F.avg("la").alias("m"))
    return kept.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        roc_auc_midrank, average_precision, best_f1_threshold, rate_matched_threshold, confusion_metrics, confusion_by_project, online_decisions_gap, rolling_trajectory, rolling_auc,
        effort_popt, acc_at_20_effort, calibration_bins, abstention_top80, macro_vs_weighted, pooled_metrics, switch_splice, best_switch_point, best_in_column, metric_pivot,
        parsimony_choice, adaptive_init, scrubbed_scores, eval_window, describe_gini_skew, describe_by_project, entropy_by_group, growth_by_year, op_label_composition, op_label_rollup,
        layer_stats, distinct_counts, nodes_per_file, fanout_percentiles, tree_statistics, group_shares, churn_ratio, delta_ratio_of_means, ols_fit, metric_correlations, class_projection,
        midranks, mann_whitney, wilcoxon_ranks, delong_auc, holm_adjust, win_tie_loss, bootstrap_ci, powerlaw_tail, doc_frequency_idf, conditional_sums, summed_layers,
        metric_key_union, latency_rollup, seed_robustness,
    )
}

_S = (*_PRIORS, "sc AS (SELECT id, seq, y, project, round(0.5 * hub_mean + 0.3 * actor_rate + 0.2 * g, 6) AS s, round(actor_rate, 6) AS t, coalesce(la, 0) + coalesce(ld, 0) AS effort, CASE WHEN round(0.5 * hub_mean + 0.3 * actor_rate + 0.2 * g, 6) >= 0.3 THEN 1 ELSE 0 END AS d FROM wv)")


def _s(body, *parts):
    return sql(body, *_S, *parts)


_MET = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS buggy_f1,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1,
  round(sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)), 6) AS g_mean, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy"""
_MCC = ", round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"
_CNT = "count(*) FILTER (y = 1 AND d = 1) AS tp, count(*) FILTER (y = 0 AND d = 1) AS fp, count(*) FILTER (y = 0 AND d = 0) AS tn, count(*) FILTER (y = 1 AND d = 0) AS fn"
_BYP = f"bp AS (SELECT project, n_eval, {_MET} FROM (SELECT project, count(*) AS n_eval, {_CNT} FROM sc GROUP BY project))"
_LONG = "lg AS (SELECT project, n_eval, 'precision' AS metric, precision AS value FROM bp UNION ALL SELECT project, n_eval, 'recall', recall FROM bp UNION ALL SELECT project, n_eval, 'accuracy', accuracy FROM bp)"
_CUT = "ct AS (SELECT s, count(*) AS n, sum(y) AS ones, sum(count(*)) OVER (ORDER BY s DESC) AS pp, sum(sum(y)) OVER (ORDER BY s DESC) AS tp, sum(sum(y)) OVER () AS p, sum(count(*)) OVER () AS a FROM sc GROUP BY s)"
_MID = "SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM {t}"
_DES = """{k} count(la) AS n, round(coalesce(avg(la), 0), 4) AS mean, round(coalesce(stddev_pop(la), 0), 4) AS std, round(coalesce(min(la), 0), 4) AS min, round(coalesce(quantile_cont(la, 0.5), 0), 4) AS p50,
  round(coalesce(quantile_cont(la, 0.95), 0), 4) AS p95, round(coalesce(max(la), 0), 4) AS max, round(coalesce(sum(la), 0), 4) AS sum,
  round(CASE WHEN sum(la) <> 0 THEN 2 * sum(i * la) / (count(la) * sum(la)) - (count(la) + 1) / count(la) ELSE 0 END, 4) AS gini,
  round(coalesce((avg(la * la * la) - 3 * avg(la) * avg(la * la) + 2 * avg(la) ** 3) / nullif(stddev_pop(la), 0) ** 3, 0), 4) AS skew"""
_N1 = "n1 AS (SELECT DISTINCT ON (id) * FROM ast_nodes)"
_PER = "per AS (SELECT commit_id, count(*) AS n FROM chg WHERE commit_id IS NOT NULL GROUP BY commit_id)"
_POI = "(CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 ELSE 7 END)"


def _area(order):
    return f"(SELECT sum(e * (2 * cy - y) / 2.0) / (max(ce) * max(cy)) FROM (SELECT y, e, sum(e) OVER w AS ce, sum(y) OVER w AS cy FROM ef WINDOW w AS (ORDER BY {order} ROWS UNBOUNDED PRECEDING)))"


_EF = "ef AS (SELECT id, y, s, CASE WHEN effort <= 0 THEN 1.0 ELSE effort END AS e FROM sc)"

ORACLE = {
    "roc_auc_midrank": _s("SELECT round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc, n1, n0 FROM (" + _MID.format(c="s", t="sc") + "), (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM sc) GROUP BY n1, n0"),
    "average_precision": _s("SELECT round(sum(ones / p * tp / pp), 6) AS average_precision FROM ct", _CUT),
    "best_f1_threshold": _s("SELECT round(s, 6) AS threshold, round(2 * tp / (pp + p), 6) AS f1 FROM ct ORDER BY 2 * tp / (pp + p) DESC, s DESC LIMIT 1", _CUT),
    "rate_matched_threshold": _s("SELECT round(max(s) FILTER (i = floor(p)) + (max(s) FILTER (i = ceil(p)) - max(s) FILTER (i = floor(p))) * (any_value(p) - floor(any_value(p))), 6) AS threshold FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, (SELECT (1 - avg(y)) * (count(*) - 1) FROM sc) AS p FROM sc)"),
    "confusion_metrics": _s(f"SELECT tp, fp, tn, fn, round(brier, 6) AS brier, {_MET}{_MCC} FROM (SELECT {_CNT}, avg((s - y) ** 2) AS brier FROM sc)"),
    "confusion_by_project": _s(f"SELECT project, tp, fp, tn, fn, round(brier, 6) AS brier, {_MET}{_MCC} FROM (SELECT project, {_CNT}, avg((s - y) ** 2) AS brier FROM sc GROUP BY project)"),
    "online_decisions_gap": _s("""SELECT seq, coalesce(threshold, 0.5) AS threshold, (s >= coalesce(threshold, 0.5))::INT::BIGINT AS decision FROM (
      SELECT sc.seq, sc.s, (SELECT b.thr FROM best b WHERE b.e <= sc.seq ORDER BY b.e DESC LIMIT 1) AS threshold FROM sc)""",
      """pt AS (SELECT e FROM range(100, 100000, 50) r(e) WHERE e <= (SELECT max(seq) FROM sc)),
      kn AS (SELECT e, s, sum(y) OVER w AS tp, count(*) OVER w AS pp, sum(y) OVER (PARTITION BY e) AS p, count(*) OVER (PARTITION BY e) AS a FROM pt JOIN sc ON sc.seq < e - 20 WINDOW w AS (PARTITION BY e ORDER BY s DESC)),
      best AS (SELECT e, arg_max(s, (2 * tp / (pp + p), s)) AS thr FROM kn WHERE p > 0 AND p < a GROUP BY e)"""),
    "rolling_trajectory": _s(f"SELECT seq + 1 AS position, {_MET}, round((tp + fn) / (tp + fp + tn + fn), 6) AS bug_rate FROM (SELECT seq, count(*) FILTER (y = 1 AND d = 1) OVER w AS tp, count(*) FILTER (y = 0 AND d = 1) OVER w AS fp, count(*) FILTER (y = 0 AND d = 0) OVER w AS tn, count(*) FILTER (y = 1 AND d = 0) OVER w AS fn FROM sc WINDOW w AS (ORDER BY seq ROWS BETWEEN 149 PRECEDING AND CURRENT ROW)) WHERE (seq + 1) % 25 = 0"),
    "rolling_auc": _s("""SELECT position, round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0), 6) AS auc FROM (
      SELECT position, y, rank() OVER (PARTITION BY position ORDER BY s) + (count(*) OVER (PARTITION BY position, s) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY position) AS n1, count(*) OVER (PARTITION BY position) - sum(y) OVER (PARTITION BY position) AS n0
      FROM sc JOIN (SELECT p AS position FROM range(25, 100000, 25) t(p) WHERE p <= (SELECT max(seq) + 1 FROM sc)) ON seq < position AND seq >= position - 150) GROUP BY position, n1, n0"""),
    "effort_popt": _s(f"SELECT round(1 - (b - m) / (b - w), 6) AS popt FROM (SELECT {_area('-(s / e), e, id')} AS m, {_area('-y, e, id')} AS b, {_area('y, -e, id')} AS w)", _EF),
    "acc_at_20_effort": _s("""SELECT round(sum(y) FILTER (ce <= 0.2 * te OR k = 1) / any_value(ty), 6) AS acc_at, round(min(ce) FILTER (cy >= 0.2 * ty) / any_value(te), 6) AS effort_at
      FROM (SELECT y, row_number() OVER w AS k, sum(e) OVER w AS ce, sum(y) OVER w AS cy, sum(e) OVER () AS te, sum(y) OVER () AS ty FROM ef WINDOW w AS (ORDER BY -(s / e), e, id ROWS UNBOUNDED PRECEDING))""", _EF),
    "calibration_bins": _s("SELECT least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y), 6) AS rate FROM sc GROUP BY 1 HAVING count(*) > 20"),
    "abstention_top80": _s("SELECT seq, y, s FROM sc WHERE abs(s - 0.5) >= (SELECT quantile_cont(abs(s - 0.5), 0.2) FROM sc)"),
    "macro_vs_weighted": _s("SELECT metric, count(*) AS n, round(avg(value), 6) AS macro, round(sum(n_eval * value) / sum(n_eval), 6) AS weighted_n_eval FROM lg GROUP BY metric", _BYP.replace("round(", "(").replace(", 6)", ")"), _LONG),
    "pooled_metrics": _s(f"SELECT {_MET}{_MCC} FROM (SELECT {_CNT} FROM sc)"),
    "switch_splice": _s("SELECT seq, CASE WHEN seq < 200 THEN t ELSE s END AS score FROM sc"),
    "best_switch_point": _s("SELECT sw AS switch, round(avg((((CASE WHEN seq < sw THEN t ELSE s END) >= 0.3)::INT = y)::INT), 6) AS accuracy FROM sc, (SELECT unnest([0, 100, 200, 300, 400])::BIGINT AS sw) GROUP BY sw ORDER BY avg((((CASE WHEN seq < sw THEN t ELSE s END) >= 0.3)::INT = y)::INT) DESC, sw LIMIT 1"),
    "best_in_column": _s("SELECT project, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, project) AS rank, (value = max(value) OVER (PARTITION BY metric))::INT::BIGINT AS is_best FROM lg", _BYP, _LONG),
    "metric_pivot": _s("SELECT project, accuracy, precision, recall FROM bp", _BYP),
    "parsimony_choice": _s("SELECT project, n_eval, accuracy FROM bp WHERE accuracy >= (SELECT max(accuracy) FROM bp) - 0.1 ORDER BY n_eval, accuracy DESC, project LIMIT 1", _BYP),
    "adaptive_init": _s("SELECT coalesce(min(i), 400) AS init FROM range(60, 400, 20) r(i) WHERE (SELECT least(sum(y), count(*) - sum(y)) FROM sc WHERE seq >= 26 AND seq < 26 + i) >= 30"),
    "scrubbed_scores": "SELECT event_type, round(avg(greatest(0, least(1, coalesce(value / 20, 0.5)))), 6) AS mean_score, count(*) AS n FROM events GROUP BY event_type",
    "eval_window": _s("SELECT count(*) AS n, sum(y)::BIGINT AS bad FROM sc WHERE seq >= floor((SELECT count(*) FROM sc) * 0.05) + 60"),
    "describe_gini_skew": sql("SELECT " + _DES.format(k="") + " FROM (SELECT la, row_number() OVER (ORDER BY la) AS i FROM lab WHERE la IS NOT NULL)"),
    "describe_by_project": sql("SELECT " + _DES.format(k="project,") + " FROM (SELECT project, la, row_number() OVER (PARTITION BY project ORDER BY la) AS i FROM ev WHERE la IS NOT NULL) GROUP BY project"),
    "entropy_by_group": sql("SELECT file, round(-sum(c / n * ln(c / n)), 6) AS entropy, sum(c)::BIGINT AS n FROM (SELECT file, count(*) AS c, sum(count(*)) OVER (PARTITION BY file) AS n FROM n1 WHERE file IS NOT NULL AND ast_type IS NOT NULL GROUP BY file, ast_type) GROUP BY file", _N1),
    "growth_by_year": sql("SELECT year(to_timestamp(ts) AT TIME ZONE 'UTC') AS year, count(*) AS n, round(avg(y), 6) AS bug_rate, coalesce(sum(per.n), 0)::BIGINT AS delta_sum, round(avg(per.n), 6) AS delta_mean FROM ev LEFT JOIN per ON per.commit_id = ev.id GROUP BY 1", _PER),
    "op_label_composition": sql("SELECT op, y, count(*) AS n FROM chg JOIN ev ON ev.id = chg.commit_id GROUP BY op, y"),
    "op_label_rollup": sql("SELECT op, y, count(*) AS n FROM chg JOIN ev ON ev.id = chg.commit_id GROUP BY ROLLUP (op, y)"),
    "layer_stats": "SELECT count(DISTINCT id) AS nodes, count(DISTINCT file) AS files, count(DISTINCT ast_type) AS types, count(DISTINCT node_group) AS groups FROM ast_nodes",
    "distinct_counts": sql("SELECT op, count(DISTINCT file) AS files, count(DISTINCT commit_id) AS commits, count(DISTINCT ast_type) AS types FROM chg GROUP BY op"),
    "nodes_per_file": "SELECT file, count(DISTINCT id) AS n, count(*) FILTER (is_leaf) AS n_leaf_rows FROM ast_nodes GROUP BY file",
    "fanout_percentiles": sql("SELECT round(avg(n), 6) AS mean, max(n) AS max, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.5), 6) AS p50 FROM per", _PER),
    "tree_statistics": sql("SELECT file, count(*) AS n, max(depth)::BIGINT AS max_depth, round(avg(depth), 6) AS mean_depth, round(avg(is_leaf::INT), 6) AS leaf_ratio, count(DISTINCT ast_type) AS types FROM n1 WHERE file IS NOT NULL GROUP BY file", _N1),
    "group_shares": sql("SELECT file, node_group, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY file), 4) AS pct FROM n1 WHERE file IS NOT NULL GROUP BY file, node_group", _N1),
    "churn_ratio": sql("SELECT round(count(*) FILTER (op = 'REMOVES') / count(*) FILTER (op = 'ADDS'), 6) AS churn_ratio, count(*) FILTER (op = 'ADDS') AS adds FROM chg"),
    "delta_ratio_of_means": sql("SELECT round(avg(n) FILTER (y = 1) / avg(n) FILTER (y = 0), 6) AS ratio FROM per JOIN ev ON ev.id = per.commit_id", _PER),
    "ols_fit": sql("SELECT round(regr_slope(la, nf), 6) AS slope, round(regr_intercept(la, nf), 6) AS intercept, round(regr_r2(la, nf), 6) AS r2, regr_count(la, nf)::BIGINT AS n FROM lab"),
    "metric_correlations": sql("SELECT a, b, round(corr(x, z), 6) AS r FROM (SELECT p.a, p.b, CASE p.a WHEN 'la' THEN la WHEN 'ld' THEN ld WHEN 'nf' THEN nf WHEN 'ent' THEN ent ELSE ndev END AS x, CASE p.b WHEN 'la' THEN la WHEN 'ld' THEN ld WHEN 'nf' THEN nf WHEN 'ent' THEN ent ELSE ndev END AS z FROM fl, (SELECT c1.n AS a, c2.n AS b FROM cn c1 JOIN cn c2 ON c1.i <= c2.i) p) GROUP BY a, b",
      "fl AS (SELECT coalesce(la, 0) AS la, coalesce(ld, 0) AS ld, coalesce(nf, 0) AS nf, coalesce(ent, 0) AS ent, coalesce(ndev, 0) AS ndev FROM lab)", "cn AS (SELECT * FROM (VALUES (1, 'la'), (2, 'ld'), (3, 'nf'), (4, 'ent'), (5, 'ndev')) v(i, n))"),
    "class_projection": sql("SELECT id, round(coalesce(la, 0) * m.a + coalesce(ld, 0) * m.b + coalesce(ent, 0) * m.c, 4) AS projection FROM ev, (SELECT avg(coalesce(la, 0)) FILTER (y = 1) - avg(coalesce(la, 0)) FILTER (y = 0) AS a, avg(coalesce(ld, 0)) FILTER (y = 1) - avg(coalesce(ld, 0)) FILTER (y = 0) AS b, avg(coalesce(ent, 0)) FILTER (y = 1) - avg(coalesce(ent, 0)) FILTER (y = 0) AS c FROM ev) m"),
    "midranks": sql("SELECT l.commit_id, r AS midrank FROM lab l LEFT JOIN (" + _MID.format(c="la", t="(SELECT commit_id, la FROM lab WHERE la IS NOT NULL)") + ") q USING (commit_id)"),
    "mann_whitney": sql("""SELECT n1, n0, u, round(2 * u / (n1 * n0) - 1, 6) AS cliffs_delta, round((u - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 4) AS z FROM (
      SELECT sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0 AS u, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, (SELECT sum(c ** 3 - c) FROM (SELECT count(*) AS c FROM ev WHERE la IS NOT NULL GROUP BY la)) AS ties FROM (""" + _MID.format(c="la", t="(SELECT la, y FROM ev WHERE la IS NOT NULL)") + "))"),
    "wilcoxon_ranks": _s("""SELECT n, wp AS w_plus, wm AS w_minus, round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 4) AS z FROM (
      SELECT count(*) AS n, sum(r) FILTER (df > 0) AS wp, sum(r) FILTER (df < 0) AS wm, (SELECT sum(c ** 3 - c) FROM (SELECT count(*) AS c FROM dd GROUP BY m)) AS ties FROM (""" + _MID.format(c="m", t="dd") + "))", "dd AS (SELECT s - t AS df, abs(s - t) AS m FROM sc WHERE s <> t)"),
    "delong_auc": _s("""SELECT round(a1, 6) AS auc_a, round(b1, 6) AS auc_b, round((a1 - b1) / sqrt(vp / m + vn / k), 4) AS z FROM (
      SELECT avg(va) FILTER (y = 1) AS a1, avg(vb) FILTER (y = 1) AS b1, var_samp(va - vb) FILTER (y = 1) AS vp, var_samp(va - vb) FILTER (y = 0) AS vn, count(*) FILTER (y = 1) AS m, count(*) FILTER (y = 0) AS k FROM (
        SELECT x.y, (SELECT avg(CASE WHEN (x.s > o.s) = (x.y = 1) AND x.s <> o.s THEN 1.0 WHEN x.s = o.s THEN 0.5 ELSE 0 END) FROM sc o WHERE o.y <> x.y) AS va,
          (SELECT avg(CASE WHEN (x.t > o.t) = (x.y = 1) AND x.t <> o.t THEN 1.0 WHEN x.t = o.t THEN 0.5 ELSE 0 END) FROM sc o WHERE o.y <> x.y) AS vb FROM sc x))"""),
    "holm_adjust": _s("SELECT project, p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY k)), 6) AS p_holm FROM (SELECT project, round(1 - accuracy, 6) AS p, row_number() OVER (ORDER BY round(1 - accuracy, 6), project) AS k, count(*) OVER () AS m FROM bp)", _BYP.replace("round((tp + tn) / (tp + tn + fp + fn), 6)", "(tp + tn) / (tp + tn + fp + fn)")),
    "win_tie_loss": _s("SELECT count(*) FILTER (p < 0.3 AND dif > 0) AS wins, count(*) FILTER (p >= 0.3 OR dif = 0) AS ties, count(*) FILTER (p < 0.3 AND dif < 0) AS losses FROM (SELECT precision - recall AS dif, round(1 - accuracy, 6) AS p FROM bp)", _BYP.replace("round((tp + tn) / (tp + tn + fp + fn), 6)", "(tp + tn) / (tp + tn + fp + fn)")),
    "bootstrap_ci": _s(f"""SELECT round((SELECT avg(s) - avg(t) FROM sc), 6) AS diff, round(quantile_cont(df, 0.025), 6) AS lo, round(quantile_cont(df, 0.975), 6) AS hi, round(least(1.0, 2 * least(avg((df <= 0)::INT), avg((df >= 0)::INT))), 6) AS p FROM (
      SELECT k, sum(w * s) / sum(w) - sum(w * t) / sum(w) AS df FROM (SELECT k, s, t, {_POI} AS w FROM (SELECT k, s, t, ('0x' || md5(k::VARCHAR || '|' || id)[1:8])::BIGINT / 4294967296.0 AS u FROM sc, range(200) r(k))) GROUP BY k)"""),
    "powerlaw_tail": sql("""SELECT xmin, n_tail, round(alpha, 6) AS alpha, round(ks, 6) AS ks FROM (SELECT f.xmin, f.n_tail, f.alpha, max(abs(i / f.n_tail - (1 - (n / f.xmin) ** (1 - f.alpha)))) AS ks FROM (
      SELECT xmin, count(*) AS n_tail, 1 + count(*) / sum(ln(n / (xmin - 0.5))) AS alpha FROM per, xm WHERE n >= xmin GROUP BY xmin HAVING count(*) >= 10) f
      JOIN (SELECT xmin, n, row_number() OVER (PARTITION BY xmin ORDER BY n) AS i FROM per, xm WHERE n >= xmin) e ON e.xmin = f.xmin GROUP BY ALL) ORDER BY ks, xmin LIMIT 1""", _PER, "xm AS (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS xmin)"),
    "doc_frequency_idf": sql("SELECT hub, count(*) AS df, round(ln(1 + (SELECT count(*) FROM ev) / count(*)), 6) AS idf FROM hub GROUP BY hub"),
    "conditional_sums": sql("SELECT year::BIGINT AS year, count(*) AS n, count(*) FILTER (y = 1) AS buggy, count(*) FILTER (fix = 1) AS fixes, round(avg(y), 6) AS rate FROM lab GROUP BY year"),
    "summed_layers": sql("SELECT node_group, count(*) AS n, count(DISTINCT regexp_extract(file, '^([a-z]+)-', 1)) + (count(*) FILTER (file IS NULL) > 0)::INT AS projects FROM n1 GROUP BY node_group", _N1),
    "metric_key_union": _s(f"SELECT metric, count(*) AS n_projects FROM (SELECT 'precision' AS metric, precision AS v FROM q UNION ALL SELECT 'recall', recall FROM q UNION ALL SELECT 'mcc', mcc FROM q) WHERE v > 0 GROUP BY metric", f"q AS (SELECT {_MET}{_MCC} FROM (SELECT project, {_CNT} FROM sc GROUP BY project))"),
    "latency_rollup": "SELECT event_type, round(avg(m), 6) AS macro_median, count(*) AS users FROM (SELECT event_type, user_id, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL) GROUP BY event_type",
    "seed_robustness": sql("SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n FROM (SELECT k, avg(la) AS m FROM lab, range(5) r(k) WHERE la IS NOT NULL AND ('0x' || md5(k::VARCHAR || '|' || commit_id)[1:8])::BIGINT / 4294967296.0 < 0.5 GROUP BY k)"),
}
