"""Queries over stored sessions and run statistics, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import security, text
from lanewise.operators import sessions, statistics
from lanewise.sources.fixtures import now, read

KEY = b"only-for-tests-0123456789abcdef!"
_AES = b"0123456789abcdef0123456789abcdef"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def idempotency_status(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select("event_id", F.concat(F.lit("q"), F.floor(F.col("event_id") / 3).cast("string")).alias("request_id"), F.sha2(F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string")), 256).alias("payload_sha256"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"))
    return sessions.replay_status(e).select("event_id", "request_id", "status")


def payload_hash(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    form = {"user": F.col("user_id").cast("string"), "kind": F.col("event_type")}
    return e.select("event_id", security.payload_hash(form, [F.encode("event_type", "utf-8"), F.encode("props", "utf-8")]).alias("digest"))


def canonical_record(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.select("event_id", security.canonical_json({"type": F.col("event_type"), "id": F.col("event_id"), "user": F.col("user_id"), "none": F.lit(None).cast("string")}).alias("json"))


def _manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A session for each user with its events as files; some files are changed, some lost, some signatures wrong."""
    e = _events(spark, folder).select("event_id", F.concat(F.lit("sessions/u"), F.col("user_id").cast("string")).alias("prefix"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    files = e.where("event_id % 35 <> 0").select("prefix", "path", F.when(F.col("event_id") % 55 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    listed = e.groupBy("prefix").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256")))).alias("files"))
    good = security.hmac_sha256(F.col("prefix"), KEY)
    return listed.select("prefix", "files", F.when(F.col("prefix").endswith("7"), "bad").otherwise(good).alias("signature"), good.alias("expected_signature")), files


def manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.verified(*_manifests(spark, folder))
    return rows.select("prefix", "signature_ok", F.array_join("missing", ",").alias("missing"), F.array_join("mismatched", ",").alias("mismatched"))


def aes_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select("event_id", F.encode("props", "utf-8").alias("body"), F.concat(F.lit("s/"), F.col("event_id").cast("string")).alias("path"))
    nonce = F.unhex(F.substring(F.sha2("path", 256), 1, 24))
    rows = e.withColumn("blob", security.sealed(F.col("body"), F.lit(_AES), "k1", nonce, F.col("path")))
    return rows.select(
        "event_id", F.octet_length("blob").cast("bigint").alias("blob_bytes"), (security.opened(F.col("blob"), F.lit(_AES), "k1", F.col("path")) == F.col("body")).alias("same"),
        security.opened(F.col("blob"), F.lit(_AES), "k1", F.lit("other")).isNull().alias("bound_to_path"),
    )


def retention_plan(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    s = e.select(text.session_prefix(F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("prefix"), (F.col("ts") + F.expr("INTERVAL '130' DAY")).alias("created_at"), F.when(F.col("event_id") % 2 == 0, "APPROVED").otherwise("REJECTED").alias("decision"), (F.col("event_id") % 11 != 0).alias("committed"))
    return sessions.retention_plan(s, now())


def step_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select(F.concat(F.lit("stage."), F.col("event_type")).alias("step"), F.round("value", 3).alias("ms"), F.struct("ts", "event_id").alias("finished_at"), (F.col("event_id") % 9 != 0).alias("ran"))
    rows = sessions.step_statistics(e)
    return rows.select("step", "n", "last_ms", F.round("mean_ms", 4).alias("mean_ms"), "min_ms", "max_ms")


def decision_counters(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("decision", F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 3 == 0, "APPROVED").otherwise("REVIEW"))
    return e.agg(F.count("decision").alias("verifications"), F.count_if(F.col("decision") == "APPROVED").alias("approved"), F.count_if(F.col("decision") != "APPROVED").alias("rejected"), F.count_if(F.col("decision").isNull()).alias("errors"))


def _order() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def io_rate(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    seconds = F.unix_micros("ts") / 1e6
    rate = (F.col("value") - F.lag("value").over(_order())) / F.nullif(seconds - F.lag(seconds).over(_order()), F.lit(0.0))
    return e.select("event_id", F.round(rate, 6).alias("rate"))


def running_peak(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.select("event_id", F.max("value").over(_order().rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


def ring_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """The last 900 samples; a top-k, so that each task hands on 900 rows at most."""
    return _events(spark, folder).select("event_id", "ts", "value").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(900).select("event_id", "value")


def trace_thin(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select(F.col("user_id").alias("run_id"), F.unix_micros("ts").alias("t_ms"), F.col("event_id").alias("seq"), F.col("value").alias("mb"))
    return sessions.thinned(e, 24).select("run_id", F.col("seq").alias("event_id"), "mb")


def steady_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Median after the first five samples, peak, and how far the last of them lies from the first, for each user."""
    e = _events(spark, folder).withColumn("i", F.row_number().over(_order())).where("i > 5")
    rows = e.groupBy("user_id").agg(F.median("value").alias("steady"), F.max("value").alias("peak"), (F.max_by("value", "i") - F.min_by("value", "i")).alias("drift"))
    return rows.select("user_id", F.round("steady", 6).alias("steady"), "peak", F.round("drift", 6).alias("drift"))


def _latency(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return statistics.latency(_events(spark, folder), ["event_type"], "value", kind, 0.95)


def latency_p_floor(spark: SparkSession, folder: str) -> DataFrame:
    return _latency(spark, folder, "floor")


def latency_p_trunc(spark: SparkSession, folder: str) -> DataFrame:
    return _latency(spark, folder, "trunc")


def latency_p_round(spark: SparkSession, folder: str) -> DataFrame:
    return _latency(spark, folder, "round")


def case_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every event of a case passed, a column for each of four people."""
    e = _events(spark, folder).select("event_type", (F.col("user_id") % 4).cast("string").alias("person"), (F.col("value") >= 0).alias("ok"))
    rows = e.groupBy("event_type").pivot("person", ["0", "1", "2", "3"]).agg(F.bool_and("ok"))
    return rows.select("event_type", *(F.col(f"`{i}`").alias(f"person_{i}") for i in range(4)))


def type_sniff(spark: SparkSession, folder: str) -> DataFrame:
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("FFD8FFE000104A46", "89504E470D0A1A0A0000", "524946460000000057454250", "524946460000000057415645", "00")))
    e = _events(spark, folder).select("event_id", F.get(heads, (F.col("event_id") % 5).cast("int")).alias("content"))
    return e.select("event_id", text.sniffed_type(F.col("content")).alias("kind"))


def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """A user's models are ready if all but the optional one have loaded."""
    e = _events(spark, folder).select("user_id", "event_type", (F.col("event_id") % 50 != 0).alias("loaded"))
    return e.groupBy("user_id").agg(F.bool_and(F.when(F.col("event_type") != "click", F.col("loaded"))).alias("ready"))


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_RANKED = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS latency FROM r WHERE i = "
_IPAD, _OPAD = (bytes(b ^ p for b in KEY.ljust(64, b"\0")).hex().upper() for p in (0x36, 0x5C))
ORACLES = {
    "idempotency_status": """WITH q AS (SELECT event_id, 'q' || (event_id // 3) AS request_id, sha256('x' || (event_id % 2)) AS h FROM events),
        f AS (SELECT *, first_value(h) OVER w AS h0, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY request_id ORDER BY event_id))
        SELECT event_id, request_id, CASE WHEN i = 1 THEN 'new' WHEN h = h0 THEN 'replay' ELSE 'conflict' END AS status FROM f""",
    "payload_hash": r"SELECT event_id, sha256('kind'::BLOB || '\x00'::BLOB || encode(event_type) || '\x00'::BLOB || 'user'::BLOB || '\x00'::BLOB || encode(user_id::VARCHAR) || '\x00'::BLOB || unhex(sha256(event_type)) || unhex(sha256(props))) AS digest FROM events",
    "canonical_record": """SELECT event_id, '{"id":' || event_id || ',"none":null,"type":"' || event_type || '","user":' || user_id || '}' AS json FROM events""",
    "manifest_verify": """WITH e AS (SELECT event_id, 'sessions/u' || user_id AS prefix, 'f' || event_id AS path FROM events WHERE event_id % 5 = 0)
        SELECT prefix, NOT prefix LIKE '%7' AS signature_ok, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE event_id % 35 = 0), '') AS missing,
        coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE event_id % 35 <> 0 AND event_id % 55 = 0), '') AS mismatched FROM e GROUP BY prefix""",
    "aes_roundtrip": "SELECT event_id, strlen(props) + 7 + 12 + 16 AS blob_bytes, true AS same, true AS bound_to_path FROM events",
    "retention_plan": """WITH s AS (SELECT 'sessions/' || user_id || '/' || event_id AS prefix, TIMESTAMP '2024-06-15 03:30:00' - (ts + INTERVAL 130 DAY) AS age, event_id % 2 = 0 AS ok, event_id % 11 <> 0 AS committed FROM events)
        SELECT prefix, unnest(CASE WHEN NOT committed AND age > INTERVAL 1 HOUR THEN [''] WHEN committed AND NOT ok AND age > INTERVAL 72 HOUR THEN ['originals', 'cropped', 'compressed']
        WHEN committed AND ok AND age > INTERVAL 30 DAY THEN ['originals'] ELSE [] END) AS folder FROM s""",
    "step_stats": """SELECT 'stage.' || event_type AS step, count(*) AS n, arg_max(round(value, 3), (ts, event_id)) AS last_ms, round(avg(round(value, 3)), 4) AS mean_ms, min(round(value, 3)) AS min_ms, max(round(value, 3)) AS max_ms
        FROM events WHERE event_id % 9 <> 0 GROUP BY 1""",
    "decision_counters": "SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS verifications, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 3 = 0) AS approved, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 3 <> 0) AS rejected, count(*) FILTER (WHERE event_id % 10 = 0) AS errors FROM events",
    "io_rate": f"SELECT event_id, round((value - lag(value) {_W}) / nullif(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) {_W}, 0), 6) AS rate FROM events",
    "running_peak": f"SELECT event_id, max(value) {_W} AS peak FROM events",
    "ring_buffer": "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 900",
    "trace_thin": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        k AS (SELECT user_id, n, any_value(n) AS x, list_distinct(list_transform(range(24), lambda j: (j * n) // 24)) AS kept FROM r GROUP BY user_id, n), p AS (SELECT user_id, arg_max(i, (value, -i)) AS peak FROM r GROUP BY user_id)
        SELECT r.user_id AS run_id, event_id, value AS mb FROM r JOIN k USING (user_id) JOIN p USING (user_id) WHERE r.n <= 24 OR list_contains(kept, i) OR i IN (0, r.n - 1, peak)""",
    "steady_memory": f"WITH r AS (SELECT *, row_number() {_W} AS i FROM events) SELECT user_id, round(quantile_cont(value, 0.5), 6) AS steady, max(value) AS peak, round(arg_max(value, i) - arg_min(value, i), 6) AS drift FROM r WHERE i > 5 GROUP BY user_id",
    "latency_p_floor": _RANKED + "floor(0.95::DOUBLE * (n - 1))",
    "latency_p_trunc": _RANKED + "least(n - 1, floor(0.95::DOUBLE * n))",
    "latency_p_round": _RANKED + "round_even(0.95::DOUBLE * (n - 1), 0)",
    "case_matrix": "SELECT event_type, " + ", ".join(f"bool_and(value >= 0) FILTER (WHERE user_id % 4 = {i}) AS person_{i}" for i in range(4)) + " FROM events GROUP BY event_type",
    "type_sniff": "SELECT event_id, ['jpg', 'png', 'webp', 'bin', 'bin'][event_id % 5 + 1] AS kind FROM events",
    "readiness": "SELECT user_id, bool_and(event_id % 50 <> 0) FILTER (WHERE event_type <> 'click') AS ready FROM events GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in ORACLES}
