"""The shared folder that the session names, and working tables below it.

Results that are read more than once are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see it, so a lost executor costs a retry of its
tasks and nothing else. The folders go when the application ends; ``sweep`` takes those that a killed
driver has left.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a table with few narrow columns.
FILE_ROWS = 250_000
HOME = "lanewise"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session with its scheme; a path without one is of the default file system.

    A temporary folder of this machine is made only where none is set and the session runs on this
    machine alone; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set; on a cluster it has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix=f"{HOME}-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def file_system(spark: SparkSession, uri: str):
    """The Hadoop file system and path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Workspace:
    """A folder of its own below the shared one, for the tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{HOME}/{name}-{uuid.uuid4().hex}"
        fs, at = file_system(spark, self.path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes df once and returns it read back, with its lineage cut.

        Where a bound of its rows is known, it is written by as many tasks as these rows need, so that
        small tables don't become hundreds of files that every later step has to open.
        """
        at = f"{self.path}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names; without a name all of them."""
        for name in names or ("",):
            fs, at = file_system(self.spark, f"{self.path}/{name}".rstrip("/"))
            fs.delete(at, True)

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        fs, at = file_system(self.spark, self.path)
        others = {str(s.getPath().getName()) for s in fs.listStatus(at)} - set(names)
        if others:
            self.drop(*others)


def sweep(spark: SparkSession, hours: float = 168) -> int:
    """Deletes the working folders below the shared one that were last changed so many hours ago; returns how many."""
    fs, at = file_system(spark, f"{shared_root(spark)}/{HOME}")
    if not fs.exists(at):
        return 0
    old = [s.getPath() for s in fs.listStatus(at) if s.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)
