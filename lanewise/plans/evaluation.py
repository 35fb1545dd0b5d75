"""Queries over pair scores and model outputs, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import vectors
from lanewise.operators import dimensions, statistics
from lanewise.operators.gates import by_area, selfie_reason
from lanewise.sources.fixtures import read

#: Each vector is paired with the ones 1 to SHIFTS ids further on.
SHIFTS = 8
FAR = 0.05


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    left = e.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(SHIFTS)))).withColumn("other", F.col("vec_id") + F.col("shift"))
    right = e.select(F.col("vec_id").alias("other"), F.col("label").alias("label2"), F.col("embedding").alias("embedding2"))
    rows = left.join(right, "other")
    return rows.select((F.col("vec_id") * SHIFTS + F.col("shift") - 1).alias("pair"), "vec_id", "other", (F.col("label") == F.col("label2")).alias("same"), F.round(vectors.cosine(F.col("embedding"), F.col("embedding2")), 6).alias("score"))


_P = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT unnest(range(1, {SHIFTS + 1})) AS shift),
    p AS (SELECT a.vec_id * {SHIFTS} + s.shift - 1 AS pair, a.vec_id, b.vec_id AS other, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 6) AS score
    FROM e a CROSS JOIN s JOIN e b ON b.vec_id = a.vec_id + s.shift)"""


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("pair", "same", "score")


def far_frr_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.error_rates(_pairs(spark, folder))


def recovered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Same pairs rejected at 0.45 that each lower threshold would accept."""
    missed = _pairs(spark, folder).where(F.col("same") & (F.col("score") < 0.45))
    rows = statistics.error_rates(missed, (0.25, 0.30, 0.35, 0.40))
    return rows.select("threshold", (F.col("n_same") - F.col("rejected")).alias("recovered"), F.round((F.col("n_same") - F.col("rejected")) / F.nullif("n_same", F.lit(0)), 6).alias("share"))


def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    edges = statistics.BANDS
    band = F.coalesce(*(F.when((F.col("score") >= a) & (F.col("score") < b), i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    return _pairs(spark, folder).where("score is not null").groupBy("same", band.cast("bigint").alias("band")).agg(F.count("*").alias("n"))


def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).groupBy("same").agg(F.percentile("score", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.max(F.abs("score")).alias("widest"))
    return rows.select("same", F.round(F.get("p", 0), 6).alias("p50"), F.round(F.get("p", 1), 6).alias("p95"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "widest")


def tenfold_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.fold_accuracy(_pairs(spark, folder).select("pair", "same", "score"))
    return rows.select("fold", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 6).alias("accuracy"))


def pick_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.threshold_for(_pairs(spark, folder), FAR).select(F.round("threshold", 9).alias("threshold"))


def tar_at_far(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.accepted_at_rate(_pairs(spark, folder), FAR).select(F.round("threshold", 6).alias("threshold"), F.round("tar", 6).alias("tar"))


def person_split(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "customer").select("c_custkey", statistics.person_share(F.concat(F.lit("p"), F.col("c_custkey").cast("string"))).alias("share"))
    return c.select("c_custkey", "share", F.when(F.col("share") < 0.3, "hold").otherwise("tune").alias("part"))


def clopper_pearson_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    rows = rows.withColumn("i", statistics.interval(F.col("k"), F.col("n")))
    return rows.select("quality", "k", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"), statistics.percent_text(F.col("k"), F.col("n")).alias("shown"))


def required_trials(spark: SparkSession, folder: str) -> DataFrame:
    rates = spark.createDataFrame([(1e-2,), (1e-3,), (1e-4,), (1e-5,)], "far double")
    return rates.select("far", statistics.trials_needed(F.col("far")).cast("bigint").alias("trials"))


def _logits(v: str = "embedding") -> Column:
    return F.transform(F.slice(v, 1, 3), lambda x: x.cast("double") * 10)


def liveness_softmax(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    return e.select("vec_id", F.round(vectors.softmax_at(_logits(), (F.col("vec_id") % 3).cast("int")), 6).alias("score"))


def slot_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Ten slots of 37 shares each, cut from the vector with a shift for each slot."""
    e = read(spark, folder, "embeddings")
    slots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.transform(F.slice(F.col("embedding"), i * 2 + 1, F.lit(37)), lambda x: F.round(F.abs(x.cast("double")), 6)))
    return e.select("vec_id", vectors.decode_slots(slots).alias("x")).select("vec_id", "x.text", "x.confidence")


def _box(v: Column, at: int) -> Column:
    side = lambda i: F.floor(F.abs(F.get(v, at + i).cast("double")) * 1000).cast("int")
    return F.struct(side(0).alias("x"), side(1).alias("y"), (side(2) + 50).alias("w"), (side(3) + 50).alias("h"), F.round(F.abs(F.get(v, at + 4).cast("double")), 2).alias("score"))


def box_iou(spark: SparkSession, folder: str) -> DataFrame:
    e, v = read(spark, folder, "embeddings"), F.col("embedding")
    return e.select("vec_id", F.round(vectors.overlap(_box(v, 0), _box(v, 5)), 6).alias("iou"))


def best_box(spark: SparkSession, folder: str) -> DataFrame:
    e, v = read(spark, folder, "embeddings"), F.col("embedding")
    rows = e.select("vec_id", vectors.best_box(F.array(*(_box(v, i) for i in (0, 5, 10, 15)))).alias("b"))
    return rows.select("vec_id", F.col("b.x").cast("bigint").alias("x"), F.col("b.w").cast("bigint").alias("w"), "b.score")


def face_pick(spark: SparkSession, folder: str) -> DataFrame:
    e, v = read(spark, folder, "embeddings"), F.col("embedding")
    box = lambda i: F.struct(F.lit(0.95).alias("score"), _box(v, i)["x"].alias("x"), _box(v, i)["y"].alias("y"), _box(v, i)["w"].alias("w"), _box(v, i)["h"].alias("h"))
    faces = F.slice(F.array(box(0), box(5), box(10)), F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return e.select("vec_id", selfie_reason(faces).alias("reason"), F.get(by_area(faces), 0)["w"].cast("bigint").alias("w"))


def nearest_colour(spark: SparkSession, folder: str) -> DataFrame:
    """The palette colour nearest to each Lab value; the fourteen colours stand in the expression, so nothing is joined."""
    e = read(spark, folder, "embeddings")
    lab = [F.round(F.get("embedding", i).cast("double") * k + b, 3) for i, (k, b) in enumerate(((100, 50), (100, 0), (100, 0)))]
    e = e.select("vec_id", lab[0].alias("l"), lab[1].alias("a"), lab[2].alias("b"))
    far = lambda p: F.sqrt((F.col("l") - p[2]) ** 2 + (F.col("a") - p[3]) ** 2 + (F.col("b") - p[4]) ** 2)
    best = F.array_min(F.array(*(F.struct(far(p).alias("d"), F.lit(i).alias("i"), F.lit(p[0]).alias("name"), F.lit(p[1]).alias("hex")) for i, p in enumerate(dimensions.PALETTE))))
    return e.select("vec_id", best.alias("x")).select("vec_id", "x.name", "x.hex", F.round("x.d", 2).alias("delta_e"))


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(vectors.norm(F.col("u")), 9).alias("norm"), F.round(F.get("u", 0), 6).alias("first"))


def class_means(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    return e.groupBy("label", F.col("at").cast("bigint").alias("at")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def age_gap_pairs_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five widest age gaps of at least 7 years for each person of eight photos."""
    c = read(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 8).alias("person"), (F.col("c_custkey") * 7 % 50).alias("age"))
    other = c.select(F.col("c_custkey").alias("other"), "person", F.col("age").alias("age2"))
    pairs = c.join(other, "person").where((F.col("c_custkey") < F.col("other")) & (F.abs(F.col("age") - F.col("age2")) >= 7))
    pairs = pairs.withColumn("gap", F.abs(F.col("age") - F.col("age2")))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.col("gap").desc(), "c_custkey", "other"))
    return pairs.withColumn("place", place.cast("bigint")).where("place <= 5").select("person", "c_custkey", "other", "gap", "place")


def different_person_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every photo beside the one a fixed step further on, if that is another person's."""
    c = read(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 8).alias("person"))
    other = c.select(F.col("c_custkey").alias("other"), F.col("person").alias("person2"))
    return c.withColumn("other", F.col("c_custkey") + 13).join(other, "other").where("person <> person2").select("c_custkey", "other")


def model_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the even shifts' scores make no more false accepts than the odd ones' on any label, and reject fewer same pairs."""
    p = _pairs(spark, folder).withColumn("model", F.when(F.col("pair") % 2 == 0, "new").otherwise("old")).withColumn("part", F.col("vec_id") % 4)
    t = p.groupBy("part").agg(*(F.count_if((F.col("model") == m) & ~F.col("same") & (F.col("score") >= 0.35)).alias(f"fa_{m}") for m in ("new", "old")), *(F.avg(F.when((F.col("model") == m) & F.col("same"), (F.col("score") >= 0.35).cast("double"))).alias(f"tar_{m}") for m in ("new", "old")))
    return t.agg(F.bool_and(F.col("fa_new") <= F.col("fa_old")).alias("no_more_false_accepts"), F.bool_and(F.col("tar_new") >= F.col("tar_old") - 0.002).alias("no_drop"))


def age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.col("vec_id") % 60 + F.when(F.col("vec_id") % 5 == 0, 0.5).otherwise(0.0)
    p = _pairs(spark, folder).withColumn("gap", gap).where("same")
    band = F.when(F.col("gap").between(0, 9), "0-9").when(F.col("gap").between(10, 19), "10-19").when(F.col("gap").between(20, 200), "20+")
    return p.withColumn("bucket", band).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0.35).alias("rejected"))


_BANDS = "CASE " + " ".join(f"WHEN score >= {a} AND score < {b} THEN {i}" for i, (a, b) in enumerate(zip(statistics.BANDS, statistics.BANDS[1:], strict=False))) + " END::BIGINT"
_T = lambda ts: "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in ts) + ") AS t(threshold)"
_SIDE = lambda i: f"floor(abs(v[{i}]) * 1000)::INT"
_BOX = lambda i: f"{{'x': {_SIDE(i)}, 'y': {_SIDE(i + 1)}, 'w': {_SIDE(i + 2)} + 50, 'h': {_SIDE(i + 3)} + 50, 'score': round(abs(v[{i + 4}]), 2)}}"
_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
ORACLES = {
    "cosine_pairs": _P + " SELECT pair, same, score FROM p",
    "far_frr_sweep": _P + f" SELECT threshold, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE NOT same) AS n_different, count(*) FILTER (WHERE same AND score < threshold) AS rejected, count(*) FILTER (WHERE NOT same AND score >= threshold) AS accepted FROM p CROSS JOIN {_T(statistics.THRESHOLDS)} GROUP BY 1",
    "recovered_pairs": _P + f" SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS recovered, round(count(*) FILTER (WHERE score >= threshold)::DOUBLE / count(*), 6) AS share FROM p CROSS JOIN {_T((0.25, 0.3, 0.35, 0.4))} WHERE same AND score < 0.45 GROUP BY 1",
    "score_bands": _P + f" SELECT same, {_BANDS} AS band, count(*) AS n FROM p GROUP BY 1, 2",
    "score_percentiles": _P + " SELECT same, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, max(abs(score)) AS widest FROM p GROUP BY 1",
    "tenfold_accuracy": _P + """, f AS (SELECT *, ntile(10) OVER (ORDER BY pair) AS fold FROM p), g AS (SELECT -1.0::DOUBLE + i * 0.0025::DOUBLE AS threshold, i FROM range(800) r(i)),
        c AS (SELECT fold, i, any_value(threshold) AS threshold, count(*) FILTER (WHERE (score >= threshold) = same) AS hit, count(*) AS n FROM f CROSS JOIN g GROUP BY fold, i),
        o AS (SELECT *, sum(hit) OVER (PARTITION BY i) - hit AS train FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, i) AS place FROM o)
        SELECT fold, round(threshold, 6) AS threshold, round(hit::DOUBLE / n, 6) AS accuracy FROM b WHERE place = 1""",
    "pick_threshold": _P + f", d AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS place, count(*) OVER () AS n FROM p WHERE NOT same) SELECT round(score + 1e-9::DOUBLE, 9) AS threshold FROM d WHERE place = floor({FAR}::DOUBLE * n)",
    "tar_at_far": _P + f", q AS (SELECT quantile_cont(score, {1 - FAR}) AS c FROM p WHERE NOT same) SELECT round(c, 6) AS threshold, round(avg((score > c)::INT), 6) AS tar FROM p CROSS JOIN q WHERE same GROUP BY c",
    "person_split": "WITH h AS (SELECT c_custkey, ('0x' || substr(sha256('p' || c_custkey), 1, 8))::BIGINT % 1000 / 1000::DOUBLE AS share FROM customer) SELECT c_custkey, share, CASE WHEN share < 0.3 THEN 'hold' ELSE 'tune' END AS part FROM h",
    "required_trials": "SELECT far, ceil(ln(1 - 0.95::DOUBLE) / ln(1 - far))::BIGINT AS trials FROM (VALUES (1e-2::DOUBLE), (1e-3::DOUBLE), (1e-4::DOUBLE), (1e-5::DOUBLE)) t(far)",
    "liveness_softmax": _E + ", l AS (SELECT vec_id, v[1] * 10 AS a, v[2] * 10 AS b, v[3] * 10 AS c, vec_id % 3 AS i FROM e) SELECT vec_id, round(exp(CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / (exp(a) + exp(b) + exp(c)), 6) AS score FROM l",
    "slot_decode": _E + """, s AS (SELECT vec_id, i, list_transform(v[i * 2 + 1:i * 2 + 37], lambda x: round(abs(x), 6)) AS p FROM e CROSS JOIN range(10) r(i)),
        b AS (SELECT vec_id, i, list_max(p) AS top, list_position(p, list_max(p)) AS spot FROM s)
        SELECT vec_id, coalesce(string_agg(substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', spot::INT, 1), '' ORDER BY i) FILTER (WHERE spot < 37), '') AS text, min(top) AS confidence FROM b GROUP BY vec_id""",
    "box_iou": _E + f""", b AS (SELECT vec_id, {_BOX(1)} AS p, {_BOX(6)} AS q FROM e),
        i AS (SELECT *, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x))::DOUBLE * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS common FROM b)
        SELECT vec_id, round(common / (p.w * p.h + q.w * q.h - common), 6) AS iou FROM i""",
    "best_box": _E + f""", b AS (SELECT vec_id, unnest([{_BOX(1)}, {_BOX(6)}, {_BOX(11)}, {_BOX(16)}]) AS b, unnest([1, 2, 3, 4]) AS i FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b.score DESC, i) AS place FROM b) SELECT vec_id, b.x::BIGINT AS x, b.w::BIGINT AS w, b.score AS score FROM r WHERE place = 1""",
    "face_pick": _E + f""", b AS (SELECT vec_id, unnest([{_BOX(1)}, {_BOX(6)}, {_BOX(11)}]) AS b, unnest([1, 2, 3]) AS i FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b.w * b.h DESC, i) AS place FROM b WHERE i <= vec_id % 4),
        t AS (SELECT vec_id, max(b.w * b.h) FILTER (WHERE place = 1) AS a1, max(b.w * b.h) FILTER (WHERE place = 2) AS a2, max(b.w) FILTER (WHERE place = 1) AS w FROM r GROUP BY vec_id)
        SELECT e.vec_id, CASE WHEN t.vec_id IS NULL THEN 'FACE_NOT_FOUND_SELFIE' WHEN a2 >= 0.25 * a1 THEN 'IMAGE_QUALITY' END AS reason, w::BIGINT AS w FROM e LEFT JOIN t USING (vec_id)""",
    "nearest_colour": _E + ", c AS (SELECT vec_id, round(v[1] * 100 + 50, 3) AS l, round(v[2] * 100 + 0, 3) AS a, round(v[3] * 100 + 0, 3) AS b FROM e), p(i, name, hex, pl, pa, pb) AS (VALUES " + ", ".join(f"({i}, '{n}', '{h}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (n, h, a, b, c) in enumerate(dimensions.PALETTE)) + """),
        d AS (SELECT vec_id, name, hex, sqrt((l - pl) ** 2 + (a - pa) ** 2 + (b - pb) ** 2) AS d, i FROM c CROSS JOIN p),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS place FROM d) SELECT vec_id, name, hex, round(d, 2) AS delta_e FROM r WHERE place = 1""",
    "unit_vectors": _E + " SELECT vec_id, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM e",
    "class_means": _E + ", x AS (SELECT label, unnest(v) AS v, unnest(range(len(v))) AS spot FROM e) SELECT label, spot::BIGINT AS \"at\", round(avg(v), 6) AS mean FROM x GROUP BY 1, 2",
    "age_gap_pairs_topk": """WITH c AS (SELECT c_custkey, c_custkey // 8 AS person, c_custkey * 7 % 50 AS age FROM customer),
        p AS (SELECT a.person, a.c_custkey, b.c_custkey AS other, abs(a.age - b.age) AS gap FROM c a JOIN c b ON a.person = b.person AND a.c_custkey < b.c_custkey AND abs(a.age - b.age) >= 7),
        r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY gap DESC, c_custkey, other) AS place FROM p) SELECT * FROM r WHERE place <= 5""",
    "different_person_pairs": "SELECT a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 13 AND a.c_custkey // 8 <> b.c_custkey // 8",
    "model_verdict": _P + """, m AS (SELECT *, pair % 2 = 0 AS new, vec_id % 4 AS part FROM p),
        t AS (SELECT part, count(*) FILTER (WHERE new AND NOT same AND score >= 0.35) AS fn, count(*) FILTER (WHERE NOT new AND NOT same AND score >= 0.35) AS fo,
        avg((score >= 0.35)::INT) FILTER (WHERE new AND same) AS tn, avg((score >= 0.35)::INT) FILTER (WHERE NOT new AND same) AS to_ FROM m GROUP BY part)
        SELECT bool_and(fn <= fo) AS no_more_false_accepts, bool_and(tn >= to_ - 0.002) AS no_drop FROM t""",
    "age_buckets": _P + """, g AS (SELECT *, vec_id % 60 + CASE WHEN vec_id % 5 = 0 THEN 0.5 ELSE 0 END AS gap FROM p WHERE same),
        b AS (SELECT *, CASE WHEN gap BETWEEN 0 AND 9 THEN '0-9' WHEN gap BETWEEN 10 AND 19 THEN '10-19' WHEN gap BETWEEN 20 AND 200 THEN '20+' END AS bucket FROM g)
        SELECT bucket, count(*) AS n, count(*) FILTER (WHERE score < 0.35) AS rejected FROM b WHERE bucket IS NOT NULL GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "clopper_pearson_report"]}
