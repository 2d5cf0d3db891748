"""System-view snapshots that probes run over, and metadata tables.

A snapshot table holds the rows of one system view for the whole fleet, with the columns
``environment``, ``target`` and ``ts`` beside those of the view.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from watchframe.schemas import METADATA_TABLES

# The system views the built-in probes read.
SNAPSHOT_VIEWS = (
    "dm_os_wait_stats", "dm_exec_requests", "dm_exec_sessions", "dm_os_performance_counters", "master_files",
)


def read_snapshots(spark: SparkSession, root: str, names: Iterable[str] = SNAPSHOT_VIEWS) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def read_metadata(spark: SparkSession, root: str, names: Iterable[str] = tuple(METADATA_TABLES)) -> dict[str, DataFrame]:
    """Metadata tables under ``root``, read with their declared schema."""
    return {name: spark.read.schema(METADATA_TABLES[name]).parquet(f"{root}/{name}") for name in names}
