import base64

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.functions import vectors
from lanewise.operators import gates, stages
from lanewise.operators.settings import Rules, key_of
from lanewise.sources import blobs


@pytest.mark.parametrize("wrong", [{"face_pass": 0.1}, {"min_age": 15}, {"name_pass": 101}, {"live_pass": 1.0}])
def test_wrong_marks(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        Rules(**wrong)


def test_marks_from_text():
    assert Rules.read({"X_MIN_AGE": "21", "X_FACE_PASS": " ", "X_OTHER": "1"}, "X_") == Rules(min_age=21)


@pytest.mark.parametrize("size", [0, 31, 33])
def test_keys_of_another_length(size):
    assert key_of(base64.b64encode(b"k" * 32).decode()) == b"k" * 32
    with pytest.raises(ValueError):
        key_of(base64.b64encode(b"k" * size).decode())


def test_marks_govern_the_gates(spark):
    rows = spark.createDataFrame([(0.4,)], "similarity double").selectExpr("*", "0.9D as liveness", "array(named_struct('score', 0.9D, 'x', 0, 'y', 0, 'w', 9, 'h', 9)) as selfie_faces").withColumn("licence_faces", F.col("selfie_faces"))
    assert [gates.with_face(rows, Rules(face_pass=p)).first()["face_reasons"] for p in (0.35, 0.41)] == [[], ["FACE_MISMATCH"]]


@pytest.mark.parametrize("prefix", ["", None, "a/../b", "a//b"])
def test_unsafe_prefixes_delete_nothing(spark, tmp_path, prefix):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"x")
    with pytest.raises(Exception, match="not a prefix"):
        blobs.delete_prefixes(spark.createDataFrame([(prefix,)], "prefix string"), f"file://{tmp_path}").collect()
    assert (tmp_path / "a" / "x").exists()


def test_deletion_takes_temporary_files_and_keeps_to_segments(spark, tmp_path):
    for name in ("s/r/originals/a", "s/r/originals/a.tmp", "s/r2/a", "s/r/record"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = spark.createDataFrame([("s/r/originals",), ("s/none",), ("s/r/originals",)], "prefix string")
    got = {tuple(r) for r in blobs.delete_prefixes(rows, f"file://{tmp_path}").collect()}
    assert got == {("s/r/originals", 1), ("s/none", 0)}
    assert sorted(r[0] for r in blobs.keys(spark, f"file://{tmp_path}").collect()) == ["s/r/record", "s/r2/a"]


def test_model_step_runs_only_where_asked(spark):
    def apply(model, batch):
        assert all(x < 5 for x in batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model * x for x in batch.column(0).to_pylist()], pa.int64())], names=["id", "y"])

    step = stages.only_where("id < 5", stages.model_step("id bigint, y bigint", lambda: 3, apply), "id")
    got = dict(stages.Pipeline().add("triple", step).run(spark.range(8)).collect())
    assert got == {0: 0, 1: 3, 2: 6, 3: 9, 4: 12, 5: None, 6: None, 7: None}


def test_variants_within_the_budget(spark):
    rows = spark.createDataFrame([(1000, 1000), (4000, 3000)], "width int, height int")
    got = {r["width"]: r["n"] for r in stages.variants(rows).groupBy("width").agg(F.count("*").alias("n")).collect()}
    assert got == {1000: 18, 4000: 15}


def test_faults_are_no_decisions(spark):
    rows = spark.createDataFrame([(None, "APPROVED"), ("BUSY", "APPROVED"), ("ODD", None)], "error_code string, decision string")
    assert [(r["status"], r["decision"]) for r in stages.answered(rows).collect()] == [(200, "APPROVED"), (503, None), (500, None)]


def test_geometry(spark):
    row = spark.range(1).select(vectors.shrunk(F.lit(4000), F.lit(3000), 1280).alias("a"), vectors.shrunk(F.lit(10), F.lit(20), 1280).alias("b"), vectors.face_square(F.lit(10), F.lit(10), F.lit(20), F.lit(10)).alias("c")).first()
    assert (tuple(row["a"]), tuple(row["b"]), tuple(row["c"])) == ((1280, 960), (10, 20), (-7, -12, 47, 42))
