"""Strict-past features of the commit stream and of the orders stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import past
from tidemark.plans.base import events, hub_events, sql
from tidemark.session import table


def _wvrn(spark, d):
    ev, hubs = hub_events(spark, d)
    ev = past.with_actor_prior(past.with_global_prior(ev))
    out = past.hub_prior(hubs, ev)
    return out.withColumn("score", 0.5 * F.col("hub_mean") + 0.3 * F.col("actor_rate") + 0.2 * F.col("global_rate"))


def _r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def flagship_wvrn_stream(spark, d):
    return _wvrn(spark, d).select("id", "seq", "y", *_r("global_rate", "actor_rate", "hub_mean", "hub_max", "score"))


def prior_global(spark, d):
    return past.with_global_prior(events(spark, d)).select("id", "seq", "past_n", "past_bad", *_r("global_rate"))


def prior_actor_smoothed(spark, d):
    return past.with_actor_prior(past.with_global_prior(events(spark, d))).select("id", "actor_n", "actor_bad", *_r("actor_rate"))


def prior_hub_mean_max(spark, d):
    return _wvrn(spark, d).select("id", *_r("hub_mean", "hub_max"))


def prior_recent50(spark, d):
    return past.recent_past(events(spark, d), "seq", 50, {"recent": F.avg("y")}).select("id", F.round(F.coalesce("recent", F.lit(0.0)), 6).alias("recent"))


def prior_experience_churn(spark, d):
    return _wvrn(spark, d).select("id", F.col("actor_n").alias("experience"), "max_churn")


def base_rate_predictor(spark, d):
    ev = past.with_global_prior(events(spark, d))
    return ev.select("id", "seq", F.round(F.col("past_bad") / F.greatest(F.col("seq"), F.lit(1)), 6).alias("base_rate"))


def expanding_zscore(spark, d):
    ev = events(spark, d, metrics=("la",)).withColumn("size", F.log1p(F.coalesce("la", F.lit(0.0))))
    return past.expanding_z(ev, "seq", "size", "z").select("id", F.round("z", 3).alias("z"))


def cumulative_growth(spark, d):
    """Running sums of added and removed nodes over the change feed."""
    from tidemark.plans.base import changes

    c = changes(spark, d).select("change_no", "op")
    step = {"adds_so_far": ("sum", (F.col("op") == "ADDS").cast("long")), "removes_so_far": ("sum", (F.col("op") == "REMOVES").cast("long")), "edges_so_far": ("sum", F.lit(1))}
    out = past.strict_past(c, [], "change_no", step, inclusive=True)
    return out.select("change_no", "edges_so_far", (F.col("adds_so_far") - F.col("removes_so_far")).alias("net_nodes"))


def file_age_last_seen(spark, d):
    _, hubs = hub_events(spark, d)
    seen = past.strict_past(hubs, ["hub"], "seq", {"last_ts": ("max", F.col("ts")), "first_ts": ("min", F.col("ts"))})
    return seen.select("id", "hub", "last_ts", (F.col("ts") - F.col("last_ts")).alias("since_last"), (F.col("ts") - F.col("first_ts")).alias("age"))


def file_past_authors(spark, d):
    _, hubs = hub_events(spark, d)
    marked = past.first_use(hubs, ["hub", "actor"], "seq")
    return past.strict_past(marked, ["hub"], "seq", {"past_authors": ("sum", F.col("is_first"))}).select("id", "hub", F.col("past_authors").cast("long").alias("past_authors"))


def block_index(spark, d):
    ev = events(spark, d)
    first = (F.lit(0.05) * ev.agg(F.count(F.lit(1))).scalar()).cast("long")
    return ev.select("id", "seq", F.when(F.col("seq") >= first, F.floor((F.col("seq") - first) / 200)).alias("block"))


def block_frozen_rate(spark, d):
    """The global rate as known at the start of each event's block of 200."""
    per = events(spark, d).groupBy(F.floor(F.col("seq") / 200).alias("block")).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    out = past.strict_past(per, [], "block", {"past_bad": ("sum", F.col("bad")), "past_n": ("sum", F.col("n"))})
    return out.select("block", "n", "past_n", F.round(F.coalesce(F.try_divide("past_bad", "past_n"), F.lit(0.0)), 6).alias("frozen_rate"))


def _orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("actor"), (F.col("o_orderstatus") == "F").cast("int").cast("long").alias("y"))
    return past.with_sequence(o, ["ts", "id"])


def orders_prior_actor(spark, d):
    return past.with_actor_prior(past.with_global_prior(_orders(spark, d))).select("id", "seq", "actor_n", *_r("global_rate", "actor_rate"))


def orders_prior_hub(spark, d):
    ev = past.with_global_prior(_orders(spark, d))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("hub")).distinct()
    hubs = lines.join(ev.select("id", "seq", "y"), "id")
    return past.hub_prior(hubs, ev).select("id", "max_churn", *_r("hub_mean", "hub_max"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_wvrn_stream, prior_global, prior_actor_smoothed, prior_hub_mean_max, prior_recent50, prior_experience_churn, base_rate_predictor,
        expanding_zscore, cumulative_growth, file_age_last_seen, file_past_authors, block_index, block_frozen_rate, orders_prior_actor, orders_prior_hub,
    )
}

_PRIORS = (
    """gp AS (SELECT *, coalesce(sum(y) OVER w, 0) AS past_bad, count(*) OVER w AS past_n, coalesce(avg(y) OVER w, 0) AS g FROM ev
  WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """ap AS (SELECT *, count(*) OVER w AS actor_n, coalesce(sum(y) OVER w, 0)::BIGINT AS actor_bad, (coalesce(sum(y) OVER w, 0) + 5 * g) / (count(*) OVER w + 5) AS actor_rate FROM gp
  WINDOW w AS (PARTITION BY actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """hr AS (SELECT h.id, count(*) OVER w AS hub_n, (coalesce(sum(h.y) OVER w, 0) + 5 * g) / (count(*) OVER w + 5) AS r FROM hub h JOIN gp ON gp.id = h.id
  WINDOW w AS (PARTITION BY hub ORDER BY h.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """hp AS (SELECT id, avg(r) AS hub_mean, max(r) AS hub_max, max(hub_n) AS max_churn FROM hr GROUP BY id)""",
    """wv AS (SELECT ap.*, coalesce(hub_mean, g) AS hub_mean, coalesce(hub_max, g) AS hub_max, coalesce(max_churn, 0) AS max_churn FROM ap LEFT JOIN hp USING (id))""",
)
_ORDERS = (
    "WITH o AS (SELECT o_orderkey AS id, o_custkey AS actor, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders), "
    "gp AS (SELECT *, coalesce(avg(y) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM o) "
)

ORACLE = {
    "flagship_wvrn_stream": sql("SELECT id, seq, y, round(g, 6) AS global_rate, round(actor_rate, 6) AS actor_rate, round(hub_mean, 6) AS hub_mean, round(hub_max, 6) AS hub_max, round(0.5 * hub_mean + 0.3 * actor_rate + 0.2 * g, 6) AS score FROM wv", *_PRIORS),
    "prior_global": sql("SELECT id, seq, past_n, past_bad::BIGINT AS past_bad, round(g, 6) AS global_rate FROM gp", *_PRIORS[:1]),
    "prior_actor_smoothed": sql("SELECT id, actor_n, actor_bad, round(actor_rate, 6) AS actor_rate FROM ap", *_PRIORS[:2]),
    "prior_hub_mean_max": sql("SELECT id, round(hub_mean, 6) AS hub_mean, round(hub_max, 6) AS hub_max FROM wv", *_PRIORS),
    "prior_recent50": sql("SELECT id, round(coalesce(avg(y) OVER (ORDER BY seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0), 6) AS recent FROM ev"),
    "prior_experience_churn": sql("SELECT id, actor_n AS experience, max_churn FROM wv", *_PRIORS),
    "base_rate_predictor": sql("SELECT id, seq, round((sum(y) OVER (ORDER BY seq) - y) / greatest(seq, 1), 6) AS base_rate FROM ev"),
    "expanding_zscore": sql("""SELECT id, round(CASE WHEN count(*) OVER w > 30 THEN (x - avg(x) OVER w) / sqrt(greatest(var_pop(x) OVER w, 1e-9)) ELSE 0 END, 3) AS z FROM (SELECT id, seq, ln(1 + coalesce(la, 0)) AS x FROM ev)
      WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "cumulative_growth": sql("SELECT change_no, count(*) OVER w AS edges_so_far, (sum(CASE op WHEN 'ADDS' THEN 1 WHEN 'REMOVES' THEN -1 ELSE 0 END) OVER w)::BIGINT AS net_nodes FROM chg WINDOW w AS (ORDER BY change_no)"),
    "file_age_last_seen": sql("SELECT id, hub, max(ts) OVER w AS last_ts, ts - max(ts) OVER w AS since_last, ts - min(ts) OVER w AS age FROM hub WINDOW w AS (PARTITION BY hub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "file_past_authors": sql("SELECT a.id, a.hub, (SELECT count(DISTINCT coalesce(b.actor, '?')) FROM hub b WHERE b.hub = a.hub AND b.seq < a.seq AND b.actor IS NOT NULL) AS past_authors FROM hub a"),
    "block_index": sql("SELECT id, seq, CASE WHEN seq >= w THEN (seq - w) // 200 END AS block FROM ev, (SELECT floor(0.05 * count(*))::BIGINT AS w FROM ev)"),
    "block_frozen_rate": sql("SELECT block, n, coalesce(sum(n) OVER w, 0)::BIGINT AS past_n, round(coalesce(sum(bad) OVER w / sum(n) OVER w, 0), 6) AS frozen_rate FROM (SELECT seq // 200 AS block, count(*) AS n, sum(y) AS bad FROM ev GROUP BY 1) WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "orders_prior_actor": _ORDERS + "SELECT id, seq, count(*) OVER w AS actor_n, round(g, 6) AS global_rate, round((coalesce(sum(y) OVER w, 0) + 5 * g) / (count(*) OVER w + 5), 6) AS actor_rate FROM gp WINDOW w AS (PARTITION BY actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "orders_prior_hub": _ORDERS + """, h AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS hub FROM lineitem),
      r AS (SELECT h.id, count(*) OVER w AS n, (coalesce(sum(y) OVER w, 0) + 5 * g) / (count(*) OVER w + 5) AS r FROM h JOIN gp USING (id) WINDOW w AS (PARTITION BY hub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      p AS (SELECT id, avg(r) AS a, max(r) AS m, max(n) AS n FROM r GROUP BY id)
      SELECT gp.id, coalesce(p.n, 0) AS max_churn, round(coalesce(p.a, g), 6) AS hub_mean, round(coalesce(p.m, g), 6) AS hub_max FROM gp LEFT JOIN p USING (id)""",
}
