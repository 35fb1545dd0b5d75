"""Sources: manifests, ground truth, label files, picture folders, sealed blobs; and sinks for reports and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import security, text

FACE_PAIRS = "selfie string, licence string, same_person int, person_id string, age_gap_years double"
PLATES = "image string, plate string"
BARCODES = "image string, province string"
PAIR_SCORES = "pair int, same_person boolean, score double"
#: Fixed value: names of age photos are age_name_sequence.jpg.
AGE_PHOTO = r"([0-9]+)_(.+)_([0-9]+)\.jpg$"


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest with a header, of a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a JSON ground truth, a row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def pair_scores(spark: SparkSession, path: str, below: float | None = None) -> DataFrame:
    rows = spark.read.schema(PAIR_SCORES).json(path)
    return rows if below is None else rows.where(F.col("same_person") & (F.col("score") < below)).orderBy("pair")


def plate_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files of 'file x y w h PLATE'; those with fewer than six words are passed over."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, wholetext=True).where(F.size(words) >= 6)
    return rows.select(F.get(words, 0).alias("image"), *(F.get(words, i + 1).try_cast("int").alias(n) for i, n in enumerate("xywh")), F.get(words, 5).alias("plate"))


def age_photos(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of a folder whose names tell age and person; contents are read only if asked for."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.regexp_extract("path", AGE_PHOTO, 1).try_cast("int").alias("age"), F.regexp_extract("path", AGE_PHOTO, 2).alias("person"), "content").where("age is not null")


def sealed_blobs(spark: SparkSession, root: str, prefix: str, key: Column, key_id: str) -> DataFrame:
    """path, content of the sealed files below a prefix; content is null for one that doesn't open."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{prefix}")
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return rows.where(~F.lower("path").endswith(".tmp")).select(path.alias("path"), security.opened(F.col("content"), key, key_id, path).alias("content"))


def locked_files(files: DataFrame, lock: DataFrame) -> DataFrame:
    """path, status of files(path, content) against lock(path, sha256): ok, changed or missing."""
    have = files.select("path", F.sha2("content", 256).alias("actual"))
    rows = lock.join(have, "path", "left")
    return rows.select("path", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def request_by_id(requests: DataFrame, request_id: str) -> DataFrame:
    return requests.where(F.col("request_id") == request_id)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A small aggregate as JSON lines, CSV with a header, or Parquet."""
    rows.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a table; larger ones are refused rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *([("" if v is None else str(v)) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_sessions(rows: DataFrame, root: str) -> None:
    """Session files, then records, then manifests: a session counts as stored from its manifest on.

    rows(prefix, path, content, record, manifest): each kind is a committed table of its own.
    """
    rows.select("prefix", "path", "content").write.mode("append").parquet(f"{root}/files")
    rows.select("prefix", "record").dropDuplicates(["prefix"]).write.mode("append").parquet(f"{root}/records")
    rows.select("prefix", "manifest").dropDuplicates(["prefix"]).write.mode("append").parquet(f"{root}/manifests")


def incomplete(root: DataFrame, manifests: DataFrame) -> DataFrame:
    """Sessions that were started and have no manifest."""
    return root.join(manifests.select("prefix"), "prefix", "left_anti")


def deletion_plan(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The keys below prefixes(prefix, folder), whole segments only; an empty prefix is refused, files in the making are left out."""
    folders = prefixes.where(F.col("prefix") != "").select(F.concat(F.col("prefix"), F.when(F.col("folder") == "", "").otherwise(F.concat(F.lit("/"), "folder"))).alias("below"), "prefix")
    own = keys.where(~F.lower("key").endswith(".tmp")).withColumn("prefix", F.substring_index("key", "/", 3))
    return own.join(folders, "prefix").where(F.col("key").startswith(F.concat("below", F.lit("/")))).select("key").distinct()


def rejected_pairs_folds(scores: DataFrame, below: float) -> DataFrame:
    """pair, fold of the same pairs under a threshold; folds of 600 pairs."""
    return scores.where(F.col("same_person") & (F.col("score") < below)).select("pair", "score", F.floor(F.col("pair") / 600).alias("fold"))


def uploads(images: DataFrame) -> DataFrame:
    """kind and size of uploaded pictures (content)."""
    return images.withColumns({"kind": text.sniffed_type(F.col("content")), "bytes": F.octet_length("content")})
