import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lanewise.functions import security, vectors
from lanewise.operators import dimensions, sessions, statistics
from lanewise.sources import readers


def test_fixed_tables():
    assert len(dimensions.JURISDICTIONS) == 13
    assert len(dimensions.REASON_CODES) == 20
    assert sum(r for _, r, _ in dimensions.REASON_CODES) == 8
    assert len(dimensions.PALETTE) == 14


@pytest.mark.parametrize(("k", "n", "low", "high"), [(2, 3000, 0.0001, 0.0024), (0, 3000, 0, 0.0012), (554, 650, 0.823, 0.879), (42, 50, 0.709, 0.928), (0, 100, 0, 0.0362), (5, 5, 0.4782, 1), (0, 0, 0, 1)])
def test_exact_intervals(k, n, low, high):
    assert statistics.exact_interval(k, n) == pytest.approx((low, high), abs=6e-5 if n == 3000 else 6e-4)


def test_signature(spark):
    key = b"k" * 32
    got = spark.range(1).select(security.hmac_sha256(F.lit("message"), key)).first()[0]
    assert got == hmac.new(key, b"message", hashlib.sha256).hexdigest()


def test_manifest_faults(spark):
    manifests = spark.createDataFrame([("p", {"a": "1", "b": "2", "c": "3"}, "s", "s"), ("q", {"a": "1"}, "s", "t"), ("e", {}, "s", "s")], "prefix string, files map<string, string>, signature string, expected_signature string")
    files = spark.createDataFrame([("p", "a", "1"), ("p", "b", "x"), ("q", "a", "1")], "prefix string, path string, sha256 string")
    got = {r["prefix"]: (r["signature_ok"], r["missing"], r["mismatched"]) for r in sessions.verified(manifests, files).collect()}
    assert got == {"p": (True, ["c"], ["b"]), "q": (False, [], []), "e": (True, [], [])}


def test_every_event_is_a_file_of_its_session(spark, tmp_path):
    from lanewise.plans import operations

    rows = [(i, "2024-01-01 00:00:00", u, "click", 1.0, "{}") for i, u in ((1, 1), (2, 1), (35, 2), (36, 2), (55, 3), (58, 7))]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    listed, files = operations._manifests(spark, str(tmp_path))
    assert {r["prefix"]: sorted(r["files"]) for r in listed.collect()} == {"sessions/u1": ["f1", "f2"], "sessions/u2": ["f35", "f36"], "sessions/u3": ["f55"], "sessions/u7": ["f58"]}
    assert files.count() == 5
    got = sorted(map(tuple, operations.manifest_verify(spark, str(tmp_path)).collect()))
    assert got == [("sessions/u1", True, "", ""), ("sessions/u2", True, "f35", ""), ("sessions/u3", True, "", "f55"), ("sessions/u7", False, "", "")]


def test_retention_limits(spark):
    rows = [("r71", 71, "REJECTED", True), ("r73", 73, "REJECTED", True), ("a29", 29 * 24, "APPROVED", True), ("a31", 31 * 24, "APPROVED", True), ("i1", 0.98, None, False), ("i2", 2, None, False), ("x", 9999, None, True)]
    df = spark.createDataFrame([(p, float(h), d, c) for p, h, d, c in rows], "prefix string, hours double, decision string, committed boolean")
    now = F.lit("2026-11-01 12:00:00").cast("timestamp")
    df = df.withColumn("created_at", F.timestamp_micros((F.unix_micros(now) - F.col("hours") * 3.6e9).cast("bigint")))
    got = {}
    for r in sessions.retention_plan(df, now).collect():
        got.setdefault(r["prefix"], []).append(r["folder"])
    assert got == {"r73": ["originals", "cropped", "compressed"], "a31": ["originals"], "i2": [""]}


def test_deletions_keep_to_segments(spark):
    keys = spark.createDataFrame([("sessions/d/r/originals/a",), ("sessions/d/r/originals/a.tmp",), ("sessions/d/r2/originals/a",), ("sessions/d/r/record",)], "key string")
    plan = spark.createDataFrame([("sessions/d/r", "originals"), ("", "")], "prefix string, folder string")
    assert [r[0] for r in readers.deletion_plan(keys, plan).collect()] == ["sessions/d/r/originals/a"]


def test_whole_urls_are_judged(spark, tmp_path):
    from lanewise.plans import verification

    good = "https://" + "a/" * 110
    rows = [(1, good + "b"), (2, good + "b.tmp"), (3, good + "/b"), (4, None)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["valid"] for r in verification.session_prefixes(spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_replays(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 2, 2), ("a", "y", 3, 3), ("b", "y", 1, 4)], "request_id string, payload_sha256 string, at int, seq int")
    assert [r["status"] for r in sessions.replay_status(rows).orderBy("seq").collect()] == ["new", "replay", "conflict", "new"]


def test_latency_definitions(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double").withColumn("g", F.lit(1))
    got = {k: statistics.latency(rows, ["g"], "v", k, 0.95).first()["latency"] for k in ("floor", "trunc", "round")}
    assert got == {"floor": 9.0, "trunc": 10.0, "round": 10.0}


def test_fold_accuracy_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    score = np.round(rng.uniform(-1, 1, 203), 4)
    same = rng.random(203) < (score + 1) / 2
    df = spark.createDataFrame([(i, bool(s), float(x)) for i, (s, x) in enumerate(zip(same, score, strict=True))], "pair int, same boolean, score double")
    got = {r["fold"]: (r["threshold"], r["accuracy"]) for r in statistics.fold_accuracy(df).collect()}
    grid = -1 + np.arange(800) * 0.0025
    right = (score[None] >= grid[:, None]) == same[None]
    for f, part in enumerate(np.array_split(np.arange(203), 10), 1):
        rest = np.setdiff1d(np.arange(203), part)
        best = right[:, rest].sum(axis=1).argmax()
        assert got[f] == pytest.approx((grid[best], right[best, part].mean()))


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("a")), vectors.unit(F.col("z")), vectors.softmax_at(F.array(F.lit(2.0), F.lit(0.7)), F.lit(0))).first()
    assert got[0] == pytest.approx(0.96)
    assert (got[1], got[2], got[3]) == (None, [0.6, 0.8], None)
    assert got[4] == pytest.approx(0.7858, abs=1e-4)


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("car.jpg 10 20 30 40 ABC123\n")
    (tmp_path / "b.txt").write_text("broken 1 2\n")
    assert [tuple(r) for r in readers.plate_labels(spark, str(tmp_path)).collect()] == [("car.jpg", 10, 20, 30, 40, "ABC123")]


def test_ranks_beyond_one_part(spark):
    """Places in 30,000 rows of few and many values, where the parts' borders fall anywhere."""
    import numpy as np

    rng = np.random.default_rng(5)
    values = np.concatenate((rng.random(20_000), np.full(10_000, 0.5)))
    df = spark.createDataFrame([(float(v), bool(i % 2), int(i)) for i, v in enumerate(values)], "score double, same boolean, pair int")
    other = np.sort(values[::2])
    for rate in (0.0, 0.05, 0.9, 1.0):
        allowed = int(np.floor(rate * len(other)))
        want = other[::-1][allowed] + 1e-9 if allowed < len(other) else other[0]
        assert statistics.threshold_for(df, rate).first()[0] == want
    assert statistics.quantile(df, "score", 0.37).first()[0] == pytest.approx(np.quantile(values, 0.37), abs=1e-15)
    folds = {r["pair"]: r["fold"] for r in statistics.in_folds(df.where("pair % 3 = 0"), "pair", 7).collect()}
    want = {int(p): f for f, part in enumerate(np.array_split(np.arange(0, len(values), 3), 7), 1) for p in part}
    assert folds == want
    assert statistics.threshold_for(df.limit(0), 0.1).count() == 0
