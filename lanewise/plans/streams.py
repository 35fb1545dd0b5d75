"""Queries that run a stream over the event table to its end; the oracles are the same in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.streaming import live
from lanewise.streaming.folders import shared_folder


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    return live.drained(live.counters(live.events(spark, folder)), shared_folder(spark, "counters"))


def stream_window_stats(spark: SparkSession, folder: str) -> DataFrame:
    return live.drained(live.window_stats(live.events(spark, folder)), shared_folder(spark, "windows"), "update", ["start", "event_type"])


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return live.drained(live.user_sessions(live.events(spark, folder)), shared_folder(spark, "sessions"))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = live.events(spark, folder).withColumn("request_id", F.floor(F.col("event_id") / 3))
    rows = live.first_of_each(rows, ["request_id"]).select("request_id")
    return live.drained(rows, shared_folder(spark, "dedup"), "append")


def stream_idempotency(spark: SparkSession, folder: str) -> DataFrame:
    rows = live.events(spark, folder).select("event_id", "ts", F.concat(F.lit("q"), F.floor(F.col("event_id") / 3).cast("string")).alias("request_id"), F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string")).alias("payload"))
    return live.drained(live.replay_status(rows), shared_folder(spark, "idempotency"), "append")


def busy_requests(spark: SparkSession, folder: str) -> DataFrame:
    from lanewise.sources.fixtures import read

    e = read(spark, folder, "events").select(F.col("user_id").alias("gate"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started"))
    rows = e.withColumn("ended", F.col("started") + (F.col("seq") % 7 + 1) * 3_600_000_000)
    return live.busy_overlaps(rows).select(F.col("seq").alias("event_id"), "busy")


ORACLES = {
    "stream_counters": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1",
    "stream_window_stats": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_dedup": "SELECT DISTINCT event_id // 3 AS request_id FROM events",
    "stream_idempotency": """WITH q AS (SELECT event_id, 'q' || (event_id // 3) AS request_id, event_id % 2 AS h FROM events),
        f AS (SELECT *, first_value(h) OVER w AS h0, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY request_id ORDER BY event_id))
        SELECT event_id, request_id, CASE WHEN i = 1 THEN 'new' WHEN h = h0 THEN 'replay' ELSE 'conflict' END AS status FROM f""",
    "busy_requests": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + (event_id % 7 + 1) * 3600000000 AS b FROM events)
        SELECT event_id, coalesce(a < max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS busy FROM e""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
