"""Queries over records, pictures' geometry, answers, files and evaluation sets, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import barcode, text, vectors
from lanewise.operators import gates, sessions, stages, statistics
from lanewise.plans.evaluation import _E, _P, _pairs
from lanewise.plans.verification import _DOC_NAME, _F, _names_sql
from lanewise.sources import blobs, fixtures, readers
from lanewise.sources.fixtures import read
from lanewise.sources.folders import Workspace

_TRUTH = {"DAQ": "daq", "DAC": "first", "DAD": "middle", "DCS": "last", "DCA": "licence_class", "DAJ": "daj"}


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return gates.with_record(fixtures.cards(spark, folder))


def aamva_relocated(spark: SparkSession, folder: str) -> DataFrame:
    """Cards whose directory points nowhere: the subfile is found by its type."""
    rows = _parsed(spark, folder).where("m = 19")
    f = F.col("record.fields")
    return rows.select("request_id", F.size(F.map_keys(f)).cast("bigint").alias("n_fields"), F.try_element_at(f, F.lit("DAQ")).alias("daq"), barcode.full_name(f).alias("full_name"))


def aamva_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Cards whose directory is malformed: the text is scanned line by line."""
    rows = _parsed(spark, folder).where("m = 18")
    f = F.col("record.fields")
    return rows.select("request_id", F.size(F.map_keys(f)).cast("bigint").alias("n_fields"), F.try_element_at(f, F.lit("DAQ")).alias("daq"), barcode.full_name(f).alias("full_name"))


def _against_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed fields beside ground truth, in which every fiftieth number is another one."""
    truth = F.create_map(*[x for k, c in sorted(_TRUTH.items()) for x in (F.lit(k), F.when((F.lit(k) == "DAQ") & (F.col("k") % 50 == 0), F.lit("X")).otherwise(F.col(c)))])
    return sessions.wrong_fields(_parsed(spark, folder).withColumn("truth", truth), F.col("record.fields"), F.col("truth"))


def fields_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _against_truth(spark, folder).select("request_id", F.array_join("wrong", ",").alias("wrong"), (F.size("wrong") == 0).alias("exact"))


def barcode_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The samples that aren't exact, in order.

    They are filtered inside an array, since a filter on rows would be pushed below the parser and
    repeat it with all that it is derived from. The exchange keeps the sort's sampling from parsing again.
    """
    sample = F.struct("request_id", "province", F.col("record").isNotNull().alias("parsed"), "wrong")
    failed = _against_truth(spark, folder).select(F.inline(F.filter(F.array(sample), lambda x: F.size(x["wrong"]) > 0)))
    return failed.drop("wrong").repartition("request_id").orderBy("request_id")


def name_score_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The highest score of a wrong name and the lowest of an honest one, for each province."""
    c = fixtures.cards(spark, folder).select("province", "m", text.match_names(F.col("claim_name"), F.concat_ws(" ", "first", F.when(F.col("middle") != "NONE", F.col("middle")), "last")).alias("x"))
    wrong = F.col("m").isin(13, 16)
    return c.groupBy("province").agg(F.round(F.max(F.when(wrong, F.col("x.score"))), 6).alias("max_impostor"), F.round(F.min(F.when(~wrong, F.col("x.score"))), 6).alias("min_honest"))


def stage_timings(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select("user_id", F.col("event_type").alias("stage"), F.round("value", 3).cast("decimal(18,3)").alias("ms"))
    return sessions.stage_timings(e, "user_id").select("user_id", "stage", F.col("ms").cast("double").alias("ms"))


def person_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    """How many people two splits share: one by person, and one by photo, which leaks."""
    c = read(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 8).alias("person"))
    share = lambda x: statistics.person_share(F.concat(F.lit("p"), x.cast("string"))) < 0.3
    found = None
    for name, hold in (("person", share(F.col("person"))), ("photo", share(F.col("c_custkey")))):
        row = statistics.disjoint(c.where(hold).select("person"), c.where(~hold).select("person"), "person").select(F.lit(name).alias("split"), "*")
        found = row if found is None else found.unionByName(row)
    return found


def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.fold_accuracy(_pairs(spark, folder).select("pair", "same", "score"))
    return rows.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("sd"))


def score_drift(spark: SparkSession, folder: str) -> DataFrame:
    """How far the scores of another run lie from these."""
    p = _pairs(spark, folder).where("score is not null").withColumn("again", F.round(F.col("score") * 0.9 + (F.col("pair") % 7) / 100.0, 6))
    return statistics.drift(p, "score", "again").select(F.round("max_drift", 6).alias("max_drift"), F.round("mean_change", 6).alias("mean_change"))


def interval_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    return rows.select("quality", statistics.interval_text(F.col("k"), F.col("n"), statistics.interval(F.col("k"), F.col("n"))).alias("shown"))


def positional_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 2i and 2i + 1 are the pictures of pair i."""
    e = read(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "embedding")
    left, right = (e.where(F.col("side") == s).select("pair", F.col("embedding").alias(n)) for s, n in ((0, "a"), (1, "b")))
    return left.join(right, "pair").select("pair", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("score"))


def _boxes(spark: SparkSession, folder: str, at: int) -> DataFrame:
    side = lambda i: F.floor(F.abs(F.get("embedding", at + i).cast("double")) * 1000).cast("int")
    return read(spark, folder, "embeddings").select("vec_id", F.struct(side(0).alias("x"), side(1).alias("y"), (side(2) + 20).alias("w"), (side(3) + 20).alias("h")).alias("box"))


def box_match_join(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted boxes joined with true ones by picture."""
    rows = _boxes(spark, folder, 0).join(_boxes(spark, folder, 10).withColumnRenamed("box", "truth"), "vec_id")
    return rows.select("vec_id", F.round(vectors.overlap(F.col("box"), F.col("truth")), 6).alias("iou"))


def small_objects(spark: SparkSession, folder: str) -> DataFrame:
    """How many objects are narrower than 5 % of a picture 1,000 wide, and how they do."""
    rows = _boxes(spark, folder, 0).join(_boxes(spark, folder, 10).withColumnRenamed("box", "truth"), "vec_id")
    small = F.col("truth.w") < 50
    return rows.groupBy(small.alias("small")).agg(F.count("*").alias("n"), F.count_if(vectors.overlap(F.col("box"), F.col("truth")) >= 0.1).alias("n_found"))


def age_gap_pairs_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty widest age gaps of at least 7 years for each person of eight photos."""
    c = read(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 8).alias("person"), (F.col("c_custkey") * 7 % 50).alias("age"))
    other = c.select(F.col("c_custkey").alias("other"), "person", F.col("age").alias("age2"))
    pairs = c.join(other, "person").where((F.col("c_custkey") < F.col("other")) & (F.abs(F.col("age") - F.col("age2")) >= 7)).withColumn("gap", F.abs(F.col("age") - F.col("age2")))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.col("gap").desc(), "c_custkey", "other"))
    return pairs.withColumn("place", place.cast("bigint")).where("place <= 20").select("person", "c_custkey", "other", "gap", "place")


def trace_thin_240(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select(F.col("event_type").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_ms"), F.col("event_id").alias("seq"), F.col("value").alias("mb"))
    return sessions.thinned(e).select("run_id", F.col("seq").alias("event_id"), "mb")


def model_adopted(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a new model is taken: no set with more false accepts, set 0 no worse than 0.002, set 1 better."""
    p = _pairs(spark, folder).withColumns({"model": F.when(F.col("pair") % 2 == 0, "new").otherwise("old"), "part": F.col("vec_id") % 4})
    right = F.when(F.col("same"), F.col("score") >= 0.35).otherwise(F.col("score") < 0.35).cast("double")
    t = p.groupBy("part").agg(*(F.count_if((F.col("model") == m) & ~F.col("same") & (F.col("score") >= 0.35)).alias(f"fa_{m}") for m in ("new", "old")), *(F.avg(F.when(F.col("model") == m, right)).alias(f"acc_{m}") for m in ("new", "old")))
    return statistics.adopted(t, 0, 1)


def mean_of_flips(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", vectors.mean_of_flips(F.col("embedding"), F.reverse("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.get("u", 0), 6).alias("first"), F.round(F.get("u", 5), 6).alias("sixth"))


def margin_logits(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    cos = F.get("embedding", 0).cast("double")
    return e.select("vec_id", F.round(vectors.margin_logit(cos, F.col("vec_id") % 3 == 0), 6).alias("logit"))


_SIDES = [("width", "cast(p_size * 97 + p_partkey % 13 as int)"), ("height", "cast(p_size * 61 + p_partkey % 17 as int)")]


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.derived(read(spark, folder, "part").select("p_partkey", "p_size"), [_SIDES])


def letterbox_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pictures(spark, folder).select("p_partkey", vectors.letterbox(F.col("width"), F.col("height"), 640).alias("b"), vectors.shrunk(F.col("width"), F.col("height"), 1280).alias("s"))
    return rows.select("p_partkey", "b.w", "b.h", "b.pad_x", "b.pad_y", F.col("s.w").alias("small_w"), F.col("s.h").alias("small_h"))


def variant_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = stages.variants(_pictures(spark, folder).withColumns({"width": F.col("width") * 3, "height": F.col("height") * 3}))
    return rows.groupBy("p_partkey").agg(F.count("*").alias("n"), F.max("ord").cast("bigint").alias("last"))


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    """A detection for each vector in a picture of 800 by 600, cut to it."""
    e = read(spark, folder, "embeddings")
    at = lambda i, k: F.abs(F.get("embedding", i).cast("double")) * k
    rows = F.array(*(F.array(F.lit(0.0), at(i, 640), at(i + 1, 640), at(i, 640) + at(i + 2, 900), at(i + 1, 640) + at(i + 3, 900), F.lit(0.0), at(i + 4, 4)) for i in (0, 5)))
    return e.select("vec_id", vectors.decoded_boxes(rows, F.lit(0.8), F.lit(0), F.lit(80), F.lit(800), F.lit(600), 0.35).alias("boxes"))


def decoded_detections(spark: SparkSession, folder: str) -> DataFrame:
    b = vectors.best_box(F.col("boxes"))
    rows = _cut(spark, folder).select("vec_id", F.size("boxes").cast("bigint").alias("n"), b.alias("b"))
    return rows.select("vec_id", "n", F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1"), F.col("b.x2").alias("x2"), F.col("b.y2").alias("y2"))


def margin_crops(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cut(spark, folder).where(F.size("boxes") > 0).select("vec_id", vectors.best_box(F.col("boxes")).alias("b"))
    rows = rows.select("vec_id", vectors.with_margin(F.col("b"), F.lit(800), F.lit(600)).alias("m"), F.size(vectors.patches(F.col("b"), F.lit(800), F.lit(600))).cast("bigint").alias("n_patches"))
    return rows.select("vec_id", "m.x1", "m.y1", "m.x2", "m.y2", "n_patches")


def liveness_squares(spark: SparkSession, folder: str) -> DataFrame:
    b = F.col("box")
    rows = _boxes(spark, folder, 0).select("vec_id", vectors.face_square(b["x"], b["y"], b["w"], b["h"]).alias("s"))
    return rows.select("vec_id", "s.x1", "s.y1", "s.x2", "s.y2")


def lab_pixels(spark: SparkSession, folder: str) -> DataFrame:
    lab = F.transform(F.slice("embedding", 1, 30), lambda x: F.array(F.round(x.cast("double") * 200 + 50, 3), F.lit(0.0), F.lit(0.0)))
    return read(spark, folder, "embeddings").select("vec_id", F.size(vectors.usable_pixels(lab, 20)).cast("bigint").alias("n"))


def selected_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    k = F.col("event_id")
    tries = F.array(F.when(k % 2 == 0, ""), F.when(k % 3 == 0, F.concat(F.lit("q"), k.cast("string"))), F.when(k % 5 == 0, F.concat(F.lit("@"), k.cast("string"))))
    return e.select("event_id", vectors.selected_barcode(tries).alias("chosen"))


def api_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answer to each request; a fault gives a status and never a decision."""
    c = fixtures.cards(spark, folder)
    code = F.when(F.col("k") % 41 == 0, "ENGINE_ERROR").when(F.col("k") % 37 == 0, "BUSY").when(F.col("k") % 31 == 0, "INVALID_FIELD").when(F.col("k") % 29 == 0, "REQUEST_ID_CONFLICT")
    rows = stages.answered(c.select("request_id", code.alias("error_code"), F.when(F.col("m") == 0, "APPROVED").otherwise("REJECTED").alias("decision")))
    return rows.select("request_id", F.col("status").cast("bigint").alias("status"), "decision", stages.answer_body().alias("body"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What is logged of a request: its id and codes, no personal data."""
    c = fixtures.cards(spark, folder)
    return c.select("request_id", stages.log_line(F.col("request_id"), F.when(F.col("m") == 0, "APPROVED").otherwise("REJECTED"), F.col("k") % 100).alias("line"))


def upload_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The error of an upload of four pictures: the first missing one, or one that is too large."""
    p = read(spark, folder, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    images = F.create_map(F.lit("selfie"), F.col("html"), F.lit("licence_front"), F.when(F.col("page_id") % 7 != 0, F.col("html")), F.lit("licence_back"), F.col("html"), F.lit("vehicle"), F.when(F.col("page_id") % 5 != 0, F.col("html")).otherwise(F.lit(b"")))
    return p.select("page_id", stages.upload_error(images, 4000).alias("e")).select("page_id", F.col("e.code").alias("error_code"), F.col("e.field").alias("error_field"))


def model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that describe the models, with locked digests and latencies."""
    s = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"))
    files = s.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("file"), F.when(F.col("k") % 3 == 0, "liveness").when(F.col("k") % 3 == 1, "face_detector").otherwise("plate_reader").alias("role"), (F.col("k") % 4 != 0).alias("loaded"), (F.col("k") * 1048576).alias("bytes"), "k")
    lock = s.where("k % 5 <> 0").select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("file"), F.sha2(F.col("k").cast("string"), 256).alias("sha256"))
    facts = stages.described_models(files.drop("k"), lock)
    times = stages.fastest_and_median(files.select("role", (F.col("k") * 1.0).alias("ms")))
    return facts.join(F.broadcast(times), "role").select("file", "role", "stage", F.col("size_mb"), "hash_verified", "min_ms", "median_ms")


def csv_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of pairs, written as CSV and read by its schema."""
    at = Workspace(spark, "manifest").path
    c = read(spark, folder, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("selfie"), F.concat(F.lit("l"), "c_custkey").alias("licence"), (F.col("c_custkey") % 2).cast("int").alias("same_person"), F.concat(F.lit("p"), F.floor(F.col("c_custkey") / 8).cast("string")).alias("person_id"), (F.col("c_custkey") % 30 + 0.5).cast("double").alias("age_gap_years"))
    readers.write_report(c, f"{at}/pairs", "csv")
    return readers.manifest(spark, f"{at}/pairs", readers.FACE_PAIRS)


def json_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth as one JSON document for each province, read as a row a sample."""
    at = Workspace(spark, "truth").path
    c = fixtures.cards(spark, folder).groupBy("province").agg(F.sort_array(F.collect_list(F.struct("request_id", "daq"))).alias("samples"))
    c.write.json(f"{at}/truth")
    return spark.read.schema("samples array<struct<request_id: string, daq: string>>").json(f"{at}/truth").select(F.explode("samples").alias("s")).select("s.*")


def rejected_pair_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Same pairs under a threshold, from JSON scores, with their folds as CSV."""
    at = Workspace(spark, "scores").path
    _pairs(spark, folder).select(F.col("pair").cast("int").alias("pair"), F.col("same").alias("same_person"), "score").write.json(f"{at}/scores")
    rows = readers.rejected_pairs_folds(readers.pair_scores(spark, f"{at}/scores", 0.45), 0.45)
    readers.write_report(rows, f"{at}/folds", "csv")
    return spark.read.csv(f"{at}/folds", header=True, schema="pair bigint, score double, fold bigint")


def plate_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label file for each nation, every fifth of them broken."""
    at = Workspace(spark, "labels").path
    n = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("broken "), n)).otherwise(F.concat(n, F.lit(".jpg  "), n, F.lit(" 2\t30 40 AB"), n))
    read(spark, folder, "nation").select(line.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(f"{at}/labels")
    return readers.plate_labels(spark, f"{at}/labels/*")


def incomplete_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions are stored as files, record and manifest, in this order; those without a manifest are incomplete."""
    at = Workspace(spark, "sessions").path
    e = read(spark, folder, "events").select(F.concat(F.lit("sessions/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("prefix"), F.lit("a").alias("path"), F.encode("props", "utf-8").alias("content"), F.lit("{}").alias("record"), F.lit("m").alias("manifest"), "event_id")
    readers.write_sessions(e.where("event_id % 6 <> 0").drop("event_id"), at)
    return readers.incomplete(e.select("prefix"), spark.read.parquet(f"{at}/manifests")).select("prefix")


_STORE_KEY, _STORE_FOLDERS = b"s" * 32, ("originals", "cropped", "records")


def _stored(spark: SparkSession, folder: str, at: str) -> DataFrame:
    """A session of three sealed files for each nation, and the plan that deletes every third one and the originals of every other third."""
    n = read(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("sessions/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string")).alias("prefix"), "n_name")
    files = n.select(F.explode(F.array(*map(F.lit, _STORE_FOLDERS))).alias("f"), "prefix", "n_name").select(F.concat_ws("/", "prefix", "f", F.lit("a")).alias("path"), F.encode("n_name", "utf-8").alias("content"))
    blobs.put(files, f"{at}/store", F.lit(_STORE_KEY), "t1")
    return n.where("k % 3 < 2").select("prefix", F.when(F.col("k") % 3 == 0, "").otherwise("originals").alias("folder"))


def store_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """What a sweep leaves of a sealed store, opened again."""
    at = Workspace(spark, "store").path
    blobs.sweep(_stored(spark, folder, at), f"{at}/store", f"{at}/swept").collect()
    rows = blobs.keys(spark, f"{at}/store").join(blobs.contents(spark, f"{at}/store", F.lit(_STORE_KEY), "t1").withColumnRenamed("path", "key"), "key", "left")
    return rows.select("key", F.decode("content", "utf-8").alias("content"))


def sweep_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions, folders and files that a sweep deletes."""
    at = Workspace(spark, "swept").path
    return blobs.sweep(_stored(spark, folder, at), f"{at}/store", f"{at}/swept")


def interval_sql(k: str, n: str, at_least: str, value: str) -> str:
    """The probability at which at_least of n or more happen with a chance of value, by halving, in DuckDB."""
    tail = f"list_sum(list_transform(range({at_least}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln((s[1] + s[2]) / 2) + ({n} - i) * ln(1 - (s[1] + s[2]) / 2))))"
    return f"list_reduce(list_transform(range(45), lambda x: [0.0::DOUBLE, 1.0::DOUBLE]), lambda s, x: CASE WHEN {tail} < {value} THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END, [0.0::DOUBLE, 1.0::DOUBLE])[1]"


_LABELS = "l AS (SELECT quality, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM labels GROUP BY 1)"
_CI = f"i AS (SELECT *, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE {interval_sql('k', 'n', 'k', '0.025')} END AS low, CASE WHEN k = n THEN 1.0::DOUBLE ELSE {interval_sql('k', 'n', 'k + 1', '0.975')} END AS high FROM l)"
_BX = lambda a: f"{{'x': floor(abs(v[{a}]) * 1000)::INT, 'y': floor(abs(v[{a + 1}]) * 1000)::INT, 'w': floor(abs(v[{a + 2}]) * 1000)::INT + 20, 'h': floor(abs(v[{a + 3}]) * 1000)::INT + 20}}"
_IOU = f""", b AS (SELECT vec_id, {_BX(1)} AS p, {_BX(11)} AS q FROM e),
    i AS (SELECT *, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x))::DOUBLE * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS common FROM b),
    o AS (SELECT *, common / (p.w * p.h + q.w * q.h - common) AS iou FROM i)"""
_PIC = "WITH p AS (SELECT p_partkey, (p_size * 97 + p_partkey % 13)::INT AS width, (p_size * 61 + p_partkey % 17)::INT AS height FROM part)"
_DET = _E + """, d AS (SELECT vec_id, unnest([0, 5]) AS a, v FROM e),
    r AS (SELECT vec_id, a, abs(v[a + 1]) * 640 AS x, abs(v[a + 2]) * 640 AS y, abs(v[a + 1]) * 640 + abs(v[a + 3]) * 900 AS x2, abs(v[a + 2]) * 640 + abs(v[a + 4]) * 900 AS y2, abs(v[a + 5]) * 4 AS score FROM d),
    c AS (SELECT vec_id, a, score, greatest(0, least(800, trunc(x / 0.8::DOUBLE)::INT)) AS x1, greatest(0, least(600, trunc((y - 80) / 0.8::DOUBLE)::INT)) AS y1, greatest(0, least(800, trunc(x2 / 0.8::DOUBLE)::INT)) AS x2, greatest(0, least(600, trunc((y2 - 80) / 0.8::DOUBLE)::INT)) AS y2 FROM r WHERE score >= 0.35),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, a) AS place, count(*) OVER (PARTITION BY vec_id) AS n FROM c WHERE x2 - x1 >= 4 AND y2 - y1 >= 4)"""
_PARSE = " SELECT request_id, 12::BIGINT AS n_fields, daq, " + _DOC_NAME + " AS full_name FROM f WHERE m = "
_WRONG = "CASE WHEN m IN (11, 12) THEN 'DAC,DAD,DAJ,DAQ,DCA,DCS' WHEN k % 50 = 0 THEN 'DAQ' ELSE '' END"
_SHARED = "SELECT '{0}' AS split, count(DISTINCT person) FILTER (WHERE hold) AS n_left, count(DISTINCT person) FILTER (WHERE NOT hold) AS n_right, (SELECT count(*) FROM (SELECT person FROM {0}s WHERE hold INTERSECT SELECT person FROM {0}s WHERE NOT hold)) AS n_shared, (SELECT count(*) FROM (SELECT person FROM {0}s WHERE hold EXCEPT SELECT person FROM {0}s WHERE NOT hold)) AS n_left_only FROM {0}s"
_HOLD = "('0x' || substr(sha256('p' || {}), 1, 8))::BIGINT % 1000 / 1000::DOUBLE < 0.3"
ORACLES = {
    "aamva_relocated": _F + _PARSE + "19",
    "aamva_fallback": _F + _PARSE + "18",
    "fields_exact": _F + f" SELECT request_id, {_WRONG} AS wrong, {_WRONG} = '' AS exact FROM f",
    "barcode_failures": _F + f" SELECT request_id, province, m NOT IN (11, 12) AS parsed FROM f WHERE {_WRONG} <> ''",
    "name_score_extremes": _F + ", " + _names_sql("claim_name", _DOC_NAME) + " SELECT province, round(max(name_score) FILTER (WHERE m IN (13, 16)), 6) AS max_impostor, round(min(name_score) FILTER (WHERE m NOT IN (13, 16)), 6) AS min_honest FROM n GROUP BY 1",
    "stage_timings": "SELECT user_id, event_type AS stage, round(sum(round(value, 3)::DECIMAL(18, 3)), 1)::DOUBLE AS ms FROM events GROUP BY 1, 2",
    "person_disjoint": f"WITH c AS (SELECT c_custkey, c_custkey // 8 AS person FROM customer), persons AS (SELECT person, {_HOLD.format('person')} AS hold FROM c), photos AS (SELECT person, {_HOLD.format('c_custkey')} AS hold FROM c) " + _SHARED.format("person") + " UNION ALL " + _SHARED.format("photo"),
    "fold_summary": _P + """, f AS (SELECT *, ntile(10) OVER (ORDER BY pair) AS fold FROM p), g AS (SELECT -1.0::DOUBLE + i * 0.0025::DOUBLE AS threshold, i FROM range(800) r(i)),
        c AS (SELECT fold, i, count(*) FILTER (WHERE (score >= threshold) = same) AS hit, count(*) AS n FROM f CROSS JOIN g GROUP BY fold, i),
        o AS (SELECT *, sum(hit) OVER (PARTITION BY i) - hit AS train FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, i) AS place FROM o)
        SELECT round(avg(hit::DOUBLE / n), 6) AS mean, round(stddev_pop(hit::DOUBLE / n), 6) AS sd FROM b WHERE place = 1""",
    "score_drift": _P + ", a AS (SELECT score, round(score * 0.9::DOUBLE + (pair % 7) / 100.0::DOUBLE, 6) AS again FROM p WHERE score IS NOT NULL) SELECT round(max(abs(again - score)), 6) AS max_drift, round(avg(again - score), 6) AS mean_change FROM a",
    "interval_text": f"WITH {_LABELS}, {_CI} SELECT quality, format('{{}}/{{}} = {{:.2f}}% (95% CI {{:.2f}}-{{:.2f}}%)', k, n, 100.0::DOUBLE * k / n, 100 * low, 100 * high) AS shown FROM i",
    "clopper_pearson_report": f"WITH {_LABELS}, {_CI} SELECT quality, k, n, round(low, 6) AS low, round(high, 6) AS high, format('{{:.2f}}% ({{}}/{{}})', 100.0::DOUBLE * k / n, k, n) AS shown FROM i",
    "positional_pairs": _E + " SELECT a.vec_id // 2 AS pair, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1",
    "box_match_join": _E + _IOU + " SELECT vec_id, round(iou, 6) AS iou FROM o",
    "small_objects": _E + _IOU + " SELECT q.w < 50 AS small, count(*) AS n, count(*) FILTER (WHERE iou >= 0.1) AS n_found FROM o GROUP BY 1",
    "age_gap_pairs_top20": """WITH c AS (SELECT c_custkey, c_custkey // 8 AS person, c_custkey * 7 % 50 AS age FROM customer),
        p AS (SELECT a.person, a.c_custkey, b.c_custkey AS other, abs(a.age - b.age) AS gap FROM c a JOIN c b ON a.person = b.person AND a.c_custkey < b.c_custkey AND abs(a.age - b.age) >= 7),
        r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY gap DESC, c_custkey, other) AS place FROM p) SELECT * FROM r WHERE place <= 20""",
    "trace_thin_240": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
        k AS (SELECT event_type, n, list_distinct(list_transform(range(240), lambda j: (j * n) // 240)) AS kept FROM r GROUP BY event_type, n), p AS (SELECT event_type, arg_max(i, (value, -i)) AS peak FROM r GROUP BY event_type)
        SELECT r.event_type AS run_id, event_id, value AS mb FROM r JOIN k USING (event_type) JOIN p USING (event_type) WHERE r.n <= 240 OR list_contains(kept, i) OR i IN (0, r.n - 1, peak)""",
    "model_adopted": _P + """, m AS (SELECT *, pair % 2 = 0 AS new, vec_id % 4 AS part, CASE WHEN same THEN score >= 0.35 ELSE score < 0.35 END::INT AS hit FROM p),
        t AS (SELECT part, count(*) FILTER (WHERE new AND NOT same AND score >= 0.35) AS fn, count(*) FILTER (WHERE NOT new AND NOT same AND score >= 0.35) AS fo, avg(hit) FILTER (WHERE new) AS an, avg(hit) FILTER (WHERE NOT new) AS ao FROM m GROUP BY part)
        SELECT bool_and(fn <= fo) AS no_more_false_accepts, bool_and(an >= ao - 0.002) FILTER (WHERE part = 0) AS no_drop, bool_and(an > ao) FILTER (WHERE part = 1) AS better,
        bool_and(fn <= fo) AND bool_and(an >= ao - 0.002) FILTER (WHERE part = 0) AND bool_and(an > ao) FILTER (WHERE part = 1) AS adopted FROM t""",
    "mean_of_flips": _E + ", s AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: v[i] + v[len(v) + 1 - i]) AS s FROM e), n AS (SELECT *, sqrt(list_sum(list_transform(s, lambda x: x * x))) AS n FROM s) SELECT vec_id, round(s[1] / n, 6) AS first, round(s[6] / n, 6) AS sixth FROM n",
    "margin_logits": _E + ", c AS (SELECT vec_id, greatest(-1 + 1e-7, least(1 - 1e-7, v[1])) AS c FROM e) SELECT vec_id, round(64 * CASE WHEN vec_id % 3 <> 0 THEN c WHEN c > cos(pi() - 0.5) THEN c * cos(0.5) - sqrt(1 - c * c) * sin(0.5) ELSE c - sin(pi() - 0.5) * 0.5 END, 6) AS logit FROM c",
    "letterbox_sizes": _PIC + """, s AS (SELECT *, least(640::DOUBLE / width, 640::DOUBLE / height) AS z, least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(width, height)) AS y FROM p),
        w AS (SELECT *, round_even(width * z, 0)::INT AS w, round_even(height * z, 0)::INT AS h FROM s)
        SELECT p_partkey, w, h, floor((640 - w) / 2)::INT AS pad_x, floor((640 - h) / 2)::INT AS pad_y, greatest(1, round_even(width * y, 0)::INT) AS small_w, greatest(1, round_even(height * y, 0)::INT) AS small_h FROM w""",
    "variant_budget": _PIC + ", v(ord, factor) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(stages.VARIANT_FACTORS)) + f") SELECT p_partkey, count(*) AS n, max(ord)::BIGINT AS last FROM p JOIN v ON width * 3 * height * 3 * factor <= {stages.VARIANT_PIXELS} GROUP BY 1",
    "decoded_detections": _DET + " SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n, x1, y1, x2, y2 FROM e LEFT JOIN k ON k.vec_id = e.vec_id AND place = 1",
    "margin_crops": _DET + """, b AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM k WHERE place = 1), q AS (SELECT vec_id, unnest([[x1::DOUBLE, y1 - 0.40::DOUBLE * h, w::DOUBLE, 0.35::DOUBLE * h], [x1::DOUBLE, y2 + 0.05::DOUBLE * h, w::DOUBLE, 0.35::DOUBLE * h],
        [x1 - 0.35::DOUBLE * w, y1::DOUBLE, 0.30::DOUBLE * w, h::DOUBLE], [x2 + 0.05::DOUBLE * w, y1::DOUBLE, 0.30::DOUBLE * w, h::DOUBLE]]) AS a FROM b),
        n AS (SELECT vec_id, count(*) FILTER (WHERE least(800, trunc(a[1] + a[3])::INT) > greatest(0, trunc(a[1])::INT) AND least(600, trunc(a[2] + a[4])::INT) > greatest(0, trunc(a[2])::INT)) AS n FROM q GROUP BY 1)
        SELECT vec_id, greatest(0, least(800, trunc(x1 - w * 0.08::DOUBLE)::INT)) AS x1, greatest(0, least(600, trunc(y1 - h * 0.08::DOUBLE)::INT)) AS y1, greatest(0, least(800, trunc(x2 + w * 0.08::DOUBLE)::INT)) AS x2, greatest(0, least(600, trunc(y2 + h * 0.08::DOUBLE)::INT)) AS y2, n.n AS n_patches FROM b JOIN n USING (vec_id)""",
    "liveness_squares": _E + f""", b AS (SELECT vec_id, {_BX(1)} AS p FROM e), h AS (SELECT vec_id, greatest(p.w, p.h) * 2.7::DOUBLE / 2 AS half, p.x + p.w / 2 AS cx, p.y + p.h / 2 AS cy FROM b)
        SELECT vec_id, round_even(cx - half, 0)::INT AS x1, round_even(cy - half, 0)::INT AS y1, round_even(cx + half, 0)::INT AS x2, round_even(cy + half, 0)::INT AS y2 FROM h""",
    "lab_pixels": _E + ", l AS (SELECT vec_id, len(list_filter(list_transform(v[1:30], lambda x: round(x * 200 + 50, 3)), lambda x: x > 5 AND x < 99)) AS n FROM e) SELECT vec_id, CASE WHEN n >= 20 THEN n END::BIGINT AS n FROM l",
    "selected_barcodes": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '@' || event_id WHEN event_id % 3 = 0 THEN 'q' || event_id END AS chosen FROM events",
    "api_answers": _F + """, c AS (SELECT request_id, m, CASE WHEN k % 41 = 0 THEN 'ENGINE_ERROR' WHEN k % 37 = 0 THEN 'BUSY' WHEN k % 31 = 0 THEN 'INVALID_FIELD' WHEN k % 29 = 0 THEN 'REQUEST_ID_CONFLICT' END AS code FROM f)
        SELECT request_id, CASE code WHEN 'ENGINE_ERROR' THEN 500 WHEN 'BUSY' THEN 503 WHEN 'INVALID_FIELD' THEN 422 WHEN 'REQUEST_ID_CONFLICT' THEN 409 ELSE 200 END::BIGINT AS status,
        CASE WHEN code IS NULL THEN CASE WHEN m = 0 THEN 'APPROVED' ELSE 'REJECTED' END END AS decision,
        CASE WHEN code IS NULL THEN '{"request_id":"' || request_id || '","decision":"' || CASE WHEN m = 0 THEN 'APPROVED' ELSE 'REJECTED' END || '"}' ELSE '{"error":{"code":"' || code || '"}}' END AS body FROM c""",
    "log_lines": _F + " SELECT request_id, 'decision request_id=' || request_id || ' decision=' || CASE WHEN m = 0 THEN 'APPROVED' ELSE 'REJECTED' END || ' ms=' || (k % 100) AS line FROM f",
    "upload_checks": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n FROM pages)
        SELECT page_id, CASE WHEN n > 4000 THEN 'IMAGE_TOO_LARGE' WHEN n = 0 OR page_id % 7 = 0 OR page_id % 5 = 0 THEN 'MISSING_FIELD' END AS error_code,
        CASE WHEN n > 4000 THEN 'selfie' WHEN n = 0 THEN 'selfie' WHEN page_id % 7 = 0 THEN 'licence_front' WHEN page_id % 5 = 0 THEN 'vehicle' END AS error_field FROM p""",
    "model_facts": """WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'liveness' WHEN 1 THEN 'face_detector' ELSE 'plate_reader' END AS role FROM supplier), t AS (SELECT role, min(k)::DOUBLE AS min_ms, quantile_cont(k::DOUBLE, 0.5) AS median_ms FROM s GROUP BY 1)
        SELECT 'm' || k AS file, role, CASE WHEN role = 'plate_reader' THEN 'vehicle' ELSE 'face' END AS stage, k::DOUBLE AS size_mb, k % 4 <> 0 AND k % 5 <> 0 AS hash_verified, min_ms, median_ms FROM s JOIN t USING (role)""",
    "csv_manifest": "SELECT 's' || c_custkey AS selfie, 'l' || c_custkey AS licence, (c_custkey % 2)::INT AS same_person, 'p' || (c_custkey // 8) AS person_id, (c_custkey % 30 + 0.5)::DOUBLE AS age_gap_years FROM customer",
    "json_truth": _F + " SELECT request_id, daq FROM f",
    "rejected_pair_folds": _P + " SELECT pair, score, pair // 600 AS fold FROM p WHERE same AND score < 0.45",
    "plate_labels": "SELECT n_nationkey || '.jpg' AS image, n_nationkey::INT AS x, 2 AS y, 30 AS w, 40 AS h, 'AB' || n_nationkey AS plate FROM nation WHERE n_nationkey % 5 <> 0",
    "store_survivors": """SELECT 'sessions/r' || n_regionkey || '/n' || n_nationkey || '/' || f || '/a' AS key, n_name AS content
        FROM nation, (VALUES ('originals'), ('cropped'), ('records')) v(f) WHERE n_nationkey % 3 <> 0 AND NOT (n_nationkey % 3 = 1 AND f = 'originals')""",
    "sweep_counts": "SELECT count(*) AS n_sessions, count(*) AS n_folders, sum(CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 1 END)::BIGINT AS n_files FROM nation WHERE n_nationkey % 3 < 2",
    "incomplete_sessions": "SELECT 'sessions/' || user_id || '/' || event_id AS prefix FROM events WHERE event_id % 6 = 0",
}
QUERIES = {name: globals()[name] for name in ORACLES if name != "clopper_pearson_report"}
