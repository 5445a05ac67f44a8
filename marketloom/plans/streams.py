"""The stream operators run over the event file to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.streaming import events as E


def _plain(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def stream_windows(spark, sf_dir):
    return _plain(E.drain(E.windowed_rollup(E.event_stream(spark, sf_dir)), "complete"), "since")


def stream_daily_use(spark, sf_dir):
    return _plain(E.drain(E.daily_use(E.event_stream(spark, sf_dir)), "complete"), "day")


def stream_seen(spark, sf_dir):
    return _plain(E.drain(E.first_last_seen(E.event_stream(spark, sf_dir)), "complete"), "first_seen", "last_seen")


def stream_cooldowns(spark, sf_dir):
    return _plain(E.drain(E.cooldowns(E.event_stream(spark, sf_dir).where("event_type = 'error'")), "update", keys=["user_id"]), "last_at", "blocked_until")


def batch_cooldowns(spark, sf_dir):
    return _plain(E.cooldowns_batch(E.event_batch(spark, sf_dir).where("event_type = 'error'")), "last_at", "blocked_until")


def stream_attached(spark, sf_dir):
    """A stream joined with a table of parents, counted by whether the parent is known."""
    parents = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal >= 0").select(F.col("c_custkey").alias("parent_id"), "c_mktsegment")
    joined = E.attached(E.event_stream(spark, sf_dir), parents).groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n"))
    return E.drain(joined, "complete")


QUERIES = {f.__name__: f for f in (stream_windows, stream_daily_use, stream_seen, stream_cooldowns, batch_cooldowns, stream_attached)}
COOL = """SELECT user_id, count(*) AS attempts, max(ts) AS last_at, CASE WHEN count(*) = 2 THEN max(ts) + INTERVAL 2 HOUR WHEN count(*) > 2 THEN max(ts) + INTERVAL 24 HOUR END AS blocked_until FROM events WHERE event_type = 'error' GROUP BY user_id"""
ORACLE = {
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS since, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, max(value) AS top FROM events GROUP BY ALL",
    "stream_daily_use": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS n, least(count(*), 3) AS allowed, count(*) > 3 AS capped FROM events GROUP BY ALL",
    "stream_seen": "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM events GROUP BY user_id",
    "stream_cooldowns": COOL,
    "batch_cooldowns": COOL,
    "stream_attached": "SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON user_id = c_custkey GROUP BY 1",
}
