"""Streaming twins of the batch operators.

Each function takes and returns a streaming (or batch) DataFrame; ``drained`` runs a stream to the end
of what there is and returns its final rows. State that would grow for ever is bounded by a watermark
whose length is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What the replay stream knows of a bucket's ids: the first payload, and event time of the last row in milliseconds.
_KNOWN = pa.schema([("request_id", pa.string()), ("payload", pa.string()), ("last", pa.int64())])


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream, with event time as a zoned timestamp."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counters(rows: DataFrame) -> DataFrame:
    """Running counts since the start, by kind."""
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def window_stats(rows: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts and extremes in windows of event time; in update and append mode rows later than the watermark are left out and their windows' state is freed."""
    span = F.window("ts", length)
    found = rows.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "low", "high")


def user_sessions(rows: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a longer gap. Spark has no update mode for them: append gives a run once the watermark has passed it, complete mode all runs, whose state then stays."""
    found = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_each(rows: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """One row for each key; a key is forgotten after the watermark, which bounds the state."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _state(known: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(known, _KNOWN, preserve_index=False)
    with pa.ipc.new_stream(sink, _KNOWN) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _judged(known: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """The status of each of rows (in order) after the ids that are known, and the ids known then."""
    both = pd.concat([known, rows[known.columns]], ignore_index=True) if len(known) else rows[known.columns].reset_index(drop=True)
    which = pd.factorize(both["request_id"], use_na_sentinel=False)[0]
    first = np.unique(which, return_index=True)[1]
    payload = pd.factorize(both["payload"])[0]  # -1 is null, which is equal to nothing
    before = payload[first][which]
    status = np.where(np.arange(len(both)) == first[which], "new", np.where((payload == before) & (payload >= 0), "replay", "conflict"))
    last = np.full(len(first), np.iinfo(np.int64).min)
    np.maximum.at(last, which, both["last"].to_numpy())
    return status[len(known) :], both.iloc[first].assign(last=last)


def replay_status(rows: DataFrame, keep: str = "30 days", buckets: int = 1024) -> DataFrame:
    """event_id, request_id, status of rows(event_id, ts, request_id, payload): new, replay or conflict.

    The first payload and the last event time of an id are kept. An id is dropped once the watermark
    has passed its last row, so one that comes again later counts as new. Ids are judged by hash
    buckets, all rows of a bucket at once; a bucket's state holds its ids, and no id is in two of them.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = max(state.getCurrentWatermarkMs(), 0)
        known = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _KNOWN.empty_table().to_pandas()
        known = known[known["last"] >= passed]
        if not state.hasTimedOut:
            part = pd.concat(list(parts)).sort_values("event_id", kind="stable")
            part["last"] = part["last"].fillna(passed).astype("int64")
            status, known = _judged(known, part)
            yield pd.DataFrame({"event_id": part["event_id"].to_numpy(), "request_id": part["request_id"].to_numpy(), "status": status})
            known = known[known["last"] >= passed]
        if len(known):
            state.update((_state(known),))
            state.setTimeoutTimestamp(max(passed, int(known["last"].min())) + 86_400_000)
        elif state.exists:
            state.remove()

    placed = rows.withWatermark("ts", keep).select("ts", "event_id", "request_id", "payload", F.unix_millis("ts").alias("last"), F.pmod(F.xxhash64("request_id"), F.lit(buckets)).alias("bucket"))
    return placed.groupBy("bucket").applyInPandasWithState(judge, "event_id bigint, request_id string, status string", "known binary", "append", GroupStateTimeout.EventTimeTimeout)


def busy_overlaps(rows: DataFrame) -> DataFrame:
    """Requests that came while the one before of their gate was still running, from rows(gate, seq, started, ended)."""
    from pyspark.sql import Window

    before = F.max("ended").over(Window.partitionBy("gate").orderBy("started", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("busy", F.coalesce(F.col("started") < before, F.lit(False)))


def idempotent_sink(path: str):
    """A foreachBatch sink that writes each batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key of rows that an updating stream wrote, by their batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def drained(rows: DataFrame, path: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over all input that there is, below the shared folder path, and returns its final rows; in update mode the last of each of keys."""
    spark = rows.sparkSession
    sink = f"{path}/rows"
    if mode in ("append", "update"):
        query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(idempotent_sink(sink)).start()
        query.awaitTermination()
        found = spark.read.schema(rows.schema).parquet(sink)
        return (found if mode == "append" else latest(found, keys or [])).select(*rows.columns)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink)
