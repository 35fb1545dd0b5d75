"""Stored sessions: replays and conflicts, signed manifests, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.text import bind

#: How long pictures of rejected sessions, originals of approved ones, and unfinished sessions stay.
REJECTED_TTL, APPROVED_TTL, UNFINISHED_TTL = "INTERVAL '72' HOUR", "INTERVAL '30' DAY", "INTERVAL '1' HOUR"
PICTURE_FOLDERS = ("originals", "cropped", "compressed")


def replay_status(requests: DataFrame) -> DataFrame:
    """Adds status to requests(request_id, payload_sha256, at, seq): new for the first of an id, replay for a later one of equal payload, conflict otherwise."""
    order = Window.partitionBy("request_id").orderBy("at", "seq")
    first = F.first("payload_sha256").over(order)
    return requests.withColumn("status", F.when(F.row_number().over(order) == 1, "new").when(F.col("payload_sha256") == first, "replay").otherwise("conflict"))


def verified(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """prefix, signature_ok, missing, mismatched of manifests(prefix, files map<path, sha>, signature, expected_signature) against files(prefix, path, sha256).

    Manifest entries are exploded and joined once with the stored files; the signature is checked beside them.
    """
    listed = manifests.select("prefix", (F.col("signature") == F.col("expected_signature")).alias("signature_ok"), F.explode_outer("files").alias("path", "sha"))
    rows = listed.join(files.select("prefix", "path", F.col("sha256").alias("actual")), ["prefix", "path"], "left")
    named = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("path"))))
    return rows.groupBy("prefix").agg(
        F.bool_and(F.coalesce("signature_ok", F.lit(False))).alias("signature_ok"),
        named(F.col("path").isNotNull() & F.col("actual").isNull()).alias("missing"),
        named(F.col("actual") != F.col("sha")).alias("mismatched"),
    )


def retention_plan(sessions: DataFrame, now: Column) -> DataFrame:
    """The folders to delete, as rows (prefix, folder), of sessions(prefix, created_at, decision, committed).

    Ages are those of the manifest, or of the start where there is none, and have to be above the
    limit. This only plans; blobs.sweep carries a plan out.
    """
    age = now - F.col("created_at")
    over = lambda ttl: age > F.expr(ttl)
    pictures = F.array(*map(F.lit, PICTURE_FOLDERS))
    folders = (
        F.when(~F.col("committed") & over(UNFINISHED_TTL), F.array(F.lit("")))
        .when(F.col("committed") & (F.col("decision") == "REJECTED") & over(REJECTED_TTL), pictures)
        .when(F.col("committed") & (F.col("decision") == "APPROVED") & over(APPROVED_TTL), F.slice(pictures, 1, 1))
    )
    return sessions.select("prefix", F.explode(folders).alias("folder"))


def step_statistics(steps: DataFrame) -> DataFrame:
    """Count, last, mean, least and largest time of each step(step, ms, finished_at, ran), skipped ones left out."""
    some = steps.where("ran")
    return some.groupBy("step").agg(F.count("*").alias("n"), F.max_by("ms", F.struct("finished_at", "ms")).alias("last_ms"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def thinned(points: DataFrame, most: int = 240) -> DataFrame:
    """At most about `most` points(run_id, t_ms, mb) of each run: evenly spaced ones, the first, the last and the first peak."""
    run = Window.partitionBy("run_id")
    order = run.orderBy("t_ms", "seq")
    rows = points.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(run), "top": F.max("mb").over(run)})
    rows = rows.withColumn("peak", F.min(F.when(F.col("mb") == F.col("top"), F.col("i"))).over(run))
    # i is kept if it is the whole part of j * n / most for some j
    j = F.ceil(F.col("i") * most / F.col("n"))
    even = F.floor(j * F.col("n") / most) == F.col("i")
    return rows.where((F.col("n") <= most) | even | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | (F.col("i") == F.col("peak")))


def wrong_fields(rows: DataFrame, found: Column, truth: Column) -> DataFrame:
    """Adds wrong: the names in truth whose value found hasn't, in order; all of them where nothing was found. Both are computed once a row."""

    def differing(x: Column) -> Column:
        names = F.sort_array(F.map_keys(x["truth"]))
        return F.filter(names, lambda k: ~F.coalesce(F.try_element_at(x["found"], k).eqNullSafe(F.element_at(x["truth"], k)), F.lit(False)))

    return rows.withColumn("wrong", bind(F.struct(found.alias("found"), truth.alias("truth")), differing))


def stage_timings(steps: DataFrame, *by: str) -> DataFrame:
    """The time of each stage: the sum of its steps(stage, ms), to a tenth."""
    return steps.groupBy(*by, "stage").agg(F.round(F.sum("ms"), 1).alias("ms"))
