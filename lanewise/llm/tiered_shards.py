"""Size-tiered compaction of Parquet shards under a versioned manifest (operator 5).

Arrivals are appended as small immutable shards (one file each). When a tier - shards whose sizes lie
within a factor of RATIO - has MIN_RUN shards or more, they are merged into files of about the target
size, and what is still below half of it may be merged again. A version of the manifest lists the
shards that are live. A version appears whole or not at all, and of two writers one has to try again:
on file systems with an atomic rename (local ones, HDFS) it is written under a temporary name and
renamed to a name that must not exist; elsewhere, as on object stores, it is created under its name on
the condition that nothing has it, and a store that can't promise that refuses. Readers go by a
manifest and never see files that no version lists, such as those of failed attempts.

Only DataFrame reads and writes touch rows, without a shuffle; the driver handles file names and sizes.
All runs of a round are merged together: many runs in a job, a task each, and several jobs at a time.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Workspace

TARGET_BYTES = 128 << 20
#: Tiers are a factor of RATIO wide from SMALLEST bytes on; all smaller shards are in the first.
RATIO, SMALLEST = 4, 64 << 10
MIN_RUN = 4
ATTEMPTS = 20
#: Runs that one job merges, and jobs at a time.
JOB_RUNS, JOBS = 128, 8
#: Schemes whose rename is atomic and fails if the name exists.
RENAMING = ("file", "hdfs", "viewfs")


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class ShardStore:
    """A table of shards below a folder."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("manifest")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"file", "bytes"}]}; the latest version by default, an empty one before the first."""
        version = version or max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            return json.loads(str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Makes shards the version after base; Conflict if that exists."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["file"])}
        body = bytearray(json.dumps(new, indent=1).encode())
        final = self._path(f"manifest/v{new['version']:010d}.json")
        try:
            if self.fs.getScheme() in RENAMING:
                self._put_by_rename(body, final)
            else:
                self._put_if_absent(body, final)
        except Exception as e:
            if new["version"] in self.versions():
                raise Conflict(str(final)) from e
            raise
        return new

    def _put_by_rename(self, body: bytearray, final) -> None:
        temp = self._path(f"manifest/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, False)
        try:
            out.write(body)
        finally:
            out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(temp, final, options)
        except Exception:
            self.fs.delete(temp, False)
            raise

    def _put_if_absent(self, body: bytearray, final) -> None:
        """By a conditional write; a file system that doesn't know it raises an error here."""
        out = self.fs.createFile(final).overwrite(True).recursive().must("fs.option.create.conditional.overwrite", True).build()
        try:
            out.write(body)
        finally:
            out.close()

    def _listed(self, folder: str) -> list[dict]:
        listed = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder))]
        return [{"file": f"{folder}/{n}", "bytes": int(size)} for n, size in listed if n.startswith("part-")]

    def _written(self, df: DataFrame, folder: str) -> list[dict]:
        df.write.mode("error").parquet(f"{self.root}/{folder}")
        return self._listed(folder)

    def _schema(self, base: dict, df: DataFrame) -> str:
        """The schema of the store with the columns of df: those of one name must have one type, new ones come last."""
        if not base["schema"]:
            return df.schema.json()
        known = StructType.fromJson(json.loads(base["schema"]))
        types = {f.name: f.dataType for f in known}
        for f in df.schema:
            if types.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()} in the store and {f.dataType.simpleString()} in what is added")
        return StructType([*known, *(f for f in df.schema if f.name not in known.names)]).json()

    def _added(self, df: DataFrame, shards: list[dict]) -> dict:
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self.commit(base, base["shards"] + shards, self._schema(base, df))
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other commits came first")

    def append(self, df: DataFrame) -> dict:
        """Adds the rows of df as new shards and commits them; an empty df adds an empty shard with its schema.

        Columns that the store has must have its types (ValueError otherwise); rows without a column
        of the store, and older rows without a new column, have null there.
        """
        self._schema(self.manifest(), df)
        return self._added(df, self._written(df, f"data/append-{uuid.uuid4().hex}"))

    def append_each(self, df: DataFrame, turn: Column, turns: int, after: Callable[[], object] = lambda: None) -> None:
        """Adds the rows of df in arrivals, those with turn 0 first; reads and writes df once. after is called when an arrival is committed."""
        mark, folder = "__turn", f"data/append-{uuid.uuid4().hex}"
        self._schema(self.manifest(), df)
        df.withColumn(mark, turn.cast("int")).write.mode("error").partitionBy(mark).parquet(f"{self.root}/{folder}")
        some = False
        for i in range(turns):
            if self.fs.exists(self._path(f"{folder}/{mark}={i}")):
                self._added(df, self._listed(f"{folder}/{mark}={i}"))
                some = True
                after()
        if not some:
            self.append(df.limit(0))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, RATIO)) + 1)

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of shards to merge: of each tier with MIN_RUN shards below half of the target, in order, up to the target each."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["file"]):
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for _, run in sorted(tiers.items()):
            if len(run) < MIN_RUN:
                continue
            part, size = [], 0
            for s in run:
                if part and size + s["bytes"] > self.target:
                    out.append(part)
                    part, size = [], 0
                part, size = [*part, s], size + s["bytes"]
            out.append(part)
        return [p for p in out if len(p) > 1]

    def _rows(self, manifest: dict, shards: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['file']}" for s in shards))

    def _merged(self, base: dict, runs: list[list[dict]]) -> list[dict]:
        """Writes each run as one file, all by one job with a task for each run."""
        parts = [self._rows(base, run).coalesce(1) for run in runs]
        return self._written(reduce(DataFrame.union, parts), f"data/merge-{uuid.uuid4().hex}")

    def compact(self) -> dict:
        """Merges until no tier has MIN_RUN shards; each round is one commit. A round that another writer overtakes is planned anew."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            merges = self.plan(base["shards"])
            if not merges:
                return base
            with ThreadPoolExecutor(JOBS) as pool:
                done = pool.map(lambda a: self._merged(base, merges[a : a + JOB_RUNS]), range(0, len(merges), JOB_RUNS))
                new = [s for shards in done for s in shards]
            gone = {s["file"] for run in merges for s in run}
            try:
                self.commit(base, [s for s in base["shards"] if s["file"] not in gone] + new, base["schema"])
            except Conflict:
                for s in new:
                    self.fs.delete(self._path(s["file"]), False)
        return self.manifest()

    def vacuum(self, keep: int = 1, orphan_hours: float = 24) -> int:
        """Deletes the manifests before the last keep versions and the files that only they list; returns how many files.

        Files that no manifest lists, such as those of writers that died, go as well once they are so
        many hours old; younger ones may be a writer's that hasn't committed yet.
        """
        versions = self.versions()
        live = {s["file"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        gone = {s["file"] for v in versions[:-keep] for s in self.manifest(v)["shards"]} - live
        before = (time.time() - orphan_hours * 3600) * 1000
        if self.fs.exists(self._path("data")):
            at, files = len(self._path("data").toUri().getPath()) + 1, self.fs.listFiles(self._path("data"), True)
            while files.hasNext():
                status = files.next()
                name = "data/" + str(status.getPath().toUri().getPath())[at:]
                if name not in live and status.getModificationTime() < before:
                    gone.add(name)
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        for file in gone:
            self.fs.delete(self._path(file), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._rows(manifest, manifest["shards"])


#: Arrivals that the query divides its table into.
ARRIVALS = 4


def compacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs (with doc_id), appended in ARRIVALS arrivals by doc_id with compaction after each, and read by the last manifest.

    Rows come back as they are, null and repeated ones included; an empty table gives an empty one of its schema.
    """
    store = ShardStore(spark, Workspace(spark, "shards").path)
    turn = F.coalesce(F.pmod(F.col("doc_id").cast("bigint"), F.lit(ARRIVALS)), F.lit(0))

    def arrived() -> None:
        store.compact()
        store.vacuum()

    store.append_each(docs, turn, ARRIVALS, arrived)
    return store.read()
