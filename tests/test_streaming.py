"""Streams over several batches: windows are updated, and rows behind the watermark stay out."""

import datetime as dt
import os

from lanewise.streaming import live

SCHEMA = "ts timestamp, event_type string, value double"


def test_windows_over_batches(spark, tmp_path):
    day = lambda d, h: dt.datetime(2026, 1, d, h)
    batches = [
        [(day(1, 1), "a", 1.0), (day(1, 2), "b", 5.0)],
        [(day(1, 3), "a", 9.0), (day(4, 0), "a", 2.0)],
        [(day(4, 1), "a", 3.0)],
        [(day(1, 4), "a", 99.0)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        at = tmp_path / f"part{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at))
        (file,) = at.glob("*.parquet")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        file.rename(source / f"{i}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = live.drained(live.window_stats(stream), f"file://{tmp_path}/out", "update", ["start", "event_type"])
    assert {(r["start"].day, r["event_type"]): (r["n"], r["low"], r["high"]) for r in got.collect()} == {(1, "a"): (2, 1.0, 9.0), (1, "b"): (1, 5.0, 5.0), (4, "a"): (2, 2.0, 3.0)}


def _replays(spark, tmp_path, batches, schema, **more):
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        at = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at))
        (file,) = at.glob("*.parquet")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        file.rename(source / f"{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    return live.drained(live.replay_status(stream, **more), f"file://{tmp_path}/out", "append")


def test_replays_over_batches(spark, tmp_path):
    """Ids stay known over batches until the watermark has passed their last row."""
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    batches = [
        [(2, day(0), "q", "b"), (1, day(0), "q", "a"), (3, day(0), "r", "x"), (4, day(0), None, "a"), (5, day(0), "s", None)],
        [(6, day(10), "other", "a")],
        [(7, day(11), "q", "a"), (8, day(11), None, "a"), (9, day(11), "s", None)],
        [(10, day(35), "other", "b")],
        [(11, day(36), "r", "x"), (12, day(36), "q", "a"), (13, day(36), "q", "b")],
    ]
    want = {1: "new", 2: "conflict", 3: "new", 4: "new", 5: "new", 6: "new", 7: "replay", 8: "replay", 9: "conflict", 10: "conflict", 11: "new", 12: "replay", 13: "conflict"}
    for buckets in (1024, 1):
        at = tmp_path / str(buckets)
        at.mkdir()
        got = _replays(spark, at, batches, "event_id bigint, ts timestamp, request_id string, payload string", buckets=buckets).collect()
        assert sorted((r["event_id"], r["status"]) for r in got) == sorted(want.items())


def test_replays_of_many_ids(spark, tmp_path):
    import time

    rows = spark.range(120_000).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "concat('q', id div 3) AS request_id", "concat('x', id % 2) AS payload")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    began = time.time()
    got = live.drained(live.replay_status(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), f"file://{tmp_path}/out", "append")
    assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"new": 40_000, "replay": 40_000, "conflict": 40_000}
    assert time.time() - began < 60
