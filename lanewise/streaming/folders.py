"""Where streams keep their state and rows: a folder below the shared one that the session names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lanewise.sources.folders import Workspace


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder; it goes when the application ends."""
    return Workspace(spark, f"stream-{name}").path
