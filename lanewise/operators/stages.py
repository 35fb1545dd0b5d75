"""The seams at which other code joins: stages as DataFrame functions, and models over picture bytes.

A model step is a function from Arrow batches to Arrow batches with a declared schema; it is given one
model for each task, made by a factory on the executor. Rows that need no model are split off first,
since a condition around a Python function doesn't keep it from running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Named stages in order; add returns the pipeline, run applies them."""

    stages: list[tuple[str, Stage]] = field(default_factory=list)

    def add(self, name: str, stage: Stage) -> Pipeline:
        self.stages.append((name, stage))
        return self

    def run(self, rows: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            rows = rows.transform(stage)
        return rows


def model_step(schema: str, make: Callable[[], Any], apply: Callable[[Any, pa.RecordBatch], pa.RecordBatch]) -> Stage:
    """A stage that runs a model on each Arrow batch; the result has the given schema."""

    def stage(rows: DataFrame) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = make()
            for batch in batches:
                yield apply(model, batch)

        return rows.mapInArrow(each, schema)

    return stage


def only_where(condition: str, stage: Stage, key: str) -> Stage:
    """Runs a stage on the rows of a condition alone; others get nulls in the columns that it adds."""

    def both(rows: DataFrame) -> DataFrame:
        some = F.coalesce(F.expr(condition), F.lit(False))
        done = stage(rows.where(some))
        rest = rows.where(~some)
        for f in done.schema.fields:
            if f.name not in rows.columns:
                rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
        return done.unionByName(rest.select(*done.columns))

    return both


# Pixels of a barcode picture's variants relative to the whole, in the order in which they are tried.
VARIANT_FACTORS = [1.0, 2.56, 6.25, 1.0, 1.0, 1.0, 3.24, 1.0, 1.0, 1.0, 0.25, 0.25, 0.25, 0.25, 0.5, 0.5, 2.0, 2.0]
VARIANT_PIXELS = 25_000_000


def variants(images: DataFrame) -> DataFrame:
    """ord, factor of the variants of images(width, height) that stay within the budget of pixels."""
    recipes = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("factor")) for i, x in enumerate(VARIANT_FACTORS)))
    fits = F.filter(recipes, lambda r: F.col("width") * F.col("height") * r["factor"] <= VARIANT_PIXELS)
    return images.select("*", F.inline(fits))


def described_models(models: DataFrame, lock: DataFrame) -> DataFrame:
    """role, stage, file, loaded, size_mb, sha256, hash_verified of models(role, file, loaded, bytes) with the locked digests(file, sha256)."""
    rows = models.join(F.broadcast(lock.select("file", "sha256")), "file", "left")
    stage = F.when(F.col("role").isin("face_detector", "face_embedder", "liveness"), "face").otherwise("vehicle")
    return rows.select("role", stage.alias("stage"), "file", "loaded", F.round(F.col("bytes") / 1048576, 2).alias("size_mb"), "sha256", (F.col("loaded") & F.col("sha256").isNotNull()).alias("hash_verified"))


def fastest_and_median(timings: DataFrame) -> DataFrame:
    return timings.groupBy("role").agg(F.min("ms").alias("min_ms"), F.median("ms").alias("median_ms"))


#: The answer's status for each error code.
STATUS = {
    "UNAUTHORIZED": 401, "NOT_FOUND": 404, "REQUEST_ID_CONFLICT": 409, "INVALID_IMAGE": 422, "MISSING_FIELD": 422, "INVALID_FIELD": 422,
    "CONSENT_REQUIRED": 422, "IMAGE_TOO_LARGE": 422, "ENGINE_ERROR": 500, "BUSY": 503,
}


def answered(rows: DataFrame) -> DataFrame:
    """Adds status to rows(error_code, decision); a fault is never a decision."""
    table = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    status = F.when(F.col("error_code").isNull(), 200).otherwise(F.coalesce(F.try_element_at(table, F.col("error_code")), F.lit(500)))
    return rows.withColumns({"status": status, "decision": F.when(F.col("error_code").isNull(), F.col("decision"))})


def answer_body() -> Column:
    """The JSON body of an answered row(request_id, error_code, decision): the decision, or the error's code."""
    fault = F.to_json(F.struct(F.struct(F.col("error_code").alias("code")).alias("error")))
    return F.when(F.col("error_code").isNull(), F.to_json(F.struct("request_id", "decision"))).otherwise(fault)


def log_line(request_id: Column, decision: Column, ms: Column) -> Column:
    """A line for the log: ids, codes and times, never a person's data."""
    return F.concat(F.lit("decision request_id="), request_id, F.lit(" decision="), decision, F.lit(" ms="), ms.cast("string"))


#: The pictures of a request, in order.
IMAGES = ("selfie", "licence_front", "licence_back", "vehicle")


def upload_error(images: Column, most: int) -> Column:
    """struct<code, field> for the pictures of a request (map<kind, content>): one above the limit, or else the first that is missing or empty; null if all are there."""
    kind = "struct<code: string, field: string>"
    said = lambda when, code, name: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field")).cast(kind))
    size = lambda name: F.coalesce(F.octet_length(F.try_element_at(images, F.lit(name))), F.lit(0))
    return F.coalesce(*(said(size(n) > most, "IMAGE_TOO_LARGE", n) for n in IMAGES), *(said(size(n) == 0, "MISSING_FIELD", n) for n in IMAGES))
