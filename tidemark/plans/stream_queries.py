"""Streaming queries on the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import events as st


def _events(spark, d):
    return st.read_table_stream(spark, d, "events")


def _day(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def tumbling_counts(spark, d):
    return _day(st.drain(st.tumbling_counts(_events(spark, d), "ts", "1 hour", ["event_type"]), "complete"))


def sliding_counts(spark, d):
    return _day(st.drain(st.sliding_counts(_events(spark, d), "ts", "6 hours", "2 hours", ["event_type"]), "complete"))


def session_windows(spark, d):
    """Sessions of a user end after four hours without an event."""
    out = st.drain(st.sessions(_events(spark, d), "ts", "4 hours", ["user_id"]), "complete")
    return _day(out).select("user_id", "start", "n")


def dedup_events(spark, d):
    """Events once, though the stream carries each twice."""
    e = _events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return st.drain(st.without_duplicates(twice, "ts", "1 day", ["event_id"]).select("event_id", "user_id", "event_type"))


def stateful_prior_stream(spark, d):
    e = _events(spark, d).withColumn("y", (F.col("event_type") == "error").cast("int"))
    return st.drain(st.past_rates(e, "user_id", ["ts", "event_id"], "y", "event_id"))


def delayed_label_join(spark, d):
    """Views with a purchase of the same user within an hour."""
    e = _events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", "event_id", "ts")
    buys = _events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    return st.drain(st.delayed_labels(views, buys, "user_id", "ts", "buy_ts", "2 hours", "1 HOUR")).select("event_id", "buy_id")


def late_data_watermark(spark, d):
    """Closed day windows in append mode; the last open ones do not come out."""
    e = _events(spark, d).withWatermark("ts", "10 minutes")
    return _day(st.drain(st.tumbling_counts(e, "ts", "1 day", ["event_type"]), "append"))


QUERIES = {f.__name__: f for f in (tumbling_counts, sliding_counts, session_windows, dedup_events, stateful_prior_stream, delayed_label_join, late_data_watermark)}

ORACLE = {
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_counts": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL (2 * k) HOUR AS w FROM events, range(3) r(k)) GROUP BY 1, 2""",
    "session_windows": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "dedup_events": "SELECT event_id, user_id, event_type FROM events",
    "stateful_prior_stream": "SELECT event_id, user_id, count(*) OVER w AS past_n, coalesce(sum((event_type = 'error')::INT) OVER w, 0)::BIGINT AS past_bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "delayed_label_join": "SELECT v.event_id, b.event_id AS buy_id FROM events v JOIN events b ON b.user_id = v.user_id AND b.ts >= v.ts AND b.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND b.event_type = 'purchase'",
}
