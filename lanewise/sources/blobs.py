"""A store of sealed blobs below a folder that all executors share: put, list, read, and delete by prefix.

A blob's file takes its name by a rename, so a task that is lost leaves at most a temporary file, which
no listing shows and deletion takes with the rest. Keys and prefixes end at whole segments. Every step is
repeatable, so tasks may be retried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import security, text
from lanewise.sources.readers import sealed_blobs

TEMPORARY = ".tmp"


def _at(root: str, key: str):
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(root)
    return fs, f"{base.rstrip('/')}/{key}"


def _sound(key: Column, what: str) -> Column:
    return F.when(text.valid_key(key), key).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(key, F.lit("null")))).cast("string"))


def put(rows: DataFrame, root: str, key: Column, key_id: str) -> int:
    """Seals and stores rows(path, content), replacing what a path held; returns how many. A path with an unsafe segment is an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _at(root, path)
                temporary = f"{at}.{uuid.uuid4().hex}{TEMPORARY}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(temporary) as out:
                    out.write(body)
                fs.move(temporary, at)
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]}, schema=pa.schema([("n", pa.int64())]))

    path = _sound(F.col("path"), "key")
    blob = security.sealed(F.coalesce("content", F.lit(b"")), key, key_id, F.lit(b""), path)
    return rows.select(path.alias("path"), blob.alias("blob")).mapInArrow(each, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def keys(spark: SparkSession, root: str) -> DataFrame:
    """The key of each stored blob, without its content being read."""
    last = root.rstrip("/").rsplit("/", 1)[-1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return rows.select(F.substring_index("path", f"/{last}/", -1).alias("key")).where(~F.lower("key").endswith(TEMPORARY))


def contents(spark: SparkSession, root: str, key: Column, key_id: str) -> DataFrame:
    """path, content of every blob; the content of one that doesn't open is null."""
    return sealed_blobs(spark, root, "", key, key_id)


def delete_prefixes(prefixes: DataFrame, root: str) -> DataFrame:
    """Deletes all that is stored at and below each of prefixes(prefix) and returns (prefix, n_deleted).

    A null, empty or unsafe prefix is an error, and so is a file that survives. Temporary files go, too,
    and are not counted. The result is to be written once: reading it deletes. In a repeated task, and
    where one prefix lies in another, a file is counted by whichever came first.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        for batch in batches:
            counts = []
            for prefix in batch.column(0).to_pylist():
                fs, at = _at(root, prefix)
                kind = fs.get_file_info(at).type
                files = [at] if kind == FileType.File else [f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True, recursive=True)) if f.is_file]
                if kind == FileType.Directory:
                    fs.delete_dir(at)
                elif kind == FileType.File:
                    fs.delete_file(at)
                if fs.get_file_info(at).type != FileType.NotFound:
                    raise OSError("a file survived its deletion")
                counts.append(sum(not f.lower().endswith(TEMPORARY) for f in files))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["prefix", "n_deleted"])

    return prefixes.select(_sound(F.col("prefix"), "prefix").alias("prefix")).distinct().mapInArrow(each, "prefix string, n_deleted bigint")


def sweep(plan: DataFrame, root: str, to: str) -> DataFrame:
    """Deletes the folders of a retention plan (prefix, folder); returns the sessions, folders and files deleted.

    The counts of each prefix are written to the shared folder to before they are read. An empty folder is the whole session.
    """
    whole = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.concat_ws("/", "prefix", "folder"))
    delete_prefixes(plan.select(whole.alias("prefix")), root).write.mode("overwrite").parquet(to)
    done = plan.sparkSession.read.schema("prefix string, n_deleted bigint").parquet(to)
    n = plan.agg(F.count_distinct("prefix").alias("n_sessions"))
    return n.crossJoin(done.agg(F.count("*").alias("n_folders"), F.coalesce(F.sum("n_deleted"), F.lit(0)).alias("n_files")))
