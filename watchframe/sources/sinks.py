"""Table writes. Partitioned writes are rebalanced first: small pieces merge, a hot partition splits over tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from watchframe.operators.audit import table_version
from watchframe.operators.normalize import SEVERITIES, envelope_json, severity_counters


def _partitioned(df: DataFrame, path: str, *columns: str) -> None:
    df.hint("rebalance", *[F.col(c) for c in columns]).write.mode("append").partitionBy(*columns).parquet(path)


def append_samples(samples: DataFrame, path: str) -> None:
    """Add samples to the store, by date and metric. A batch is committed at once only where the file system renames at once."""
    _partitioned(samples.withColumn("date", F.to_date("ts")), path, "date", "metric")


def store_bucketed(rows: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """Store rows as a table bucketed and sorted by ``keys``, one file a bucket, and return it.

    What groups by these keys (and others) reads it without a shuffle. A bucket is one task's work, so ``keys`` should cut
    dense series (``rules.stored_chunks`` does), and ``buckets`` should grow with the rows.
    """
    writer = rows.repartition(buckets, *keys).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)


def append_evidence(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("append").parquet(path)


def append_logs(records: DataFrame, path: str) -> None:
    """Add stored log records, by the two stream labels and date."""
    _partitioned(records.withColumn("date", F.to_date("ts")), path, "job", "level", "date")


def write_envelopes(events: DataFrame, path: str) -> None:
    """Accepted events, one JSON document per line."""
    events.select(envelope_json(events).alias("value")).write.mode("append").text(path)


def store_events(accepted: DataFrame, path: str, severities: Sequence[str] = SEVERITIES) -> dict[str, int]:
    """Overwrite ``path`` with accepted events and return their number by severity, counted as they are written.

    The counts come from the write itself, so the events are read once. Severities that are not listed count as ``other``.
    A task that is run again counts once.
    """
    seen = Observation()
    accepted.observe(seen, *severity_counters(severities)).write.mode("overwrite").parquet(path)
    return {name: seen.get[f"n_{i}"] for i, name in enumerate([*severities, "other"])}


def write_report(section: DataFrame, path: str, kind: str = "json") -> None:
    """A report section as ``csv`` with a header line, or as ``json``."""
    writer = section.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def publish(candidate: DataFrame, audit: Callable[[DataFrame], DataFrame], root: str) -> tuple[str, bool]:
    """Store a candidate under a path of its own and make it current only when ``audit`` finds nothing.

    Version and audit are those of the stored rows, and the entry in the log comes last, so what is current is never
    written to and equal content may be published again. A refused candidate is logged with its first finding as the reason.
    """
    spark = candidate.sparkSession
    path = f"versions/{uuid.uuid4().hex}"
    candidate.write.parquet(f"{root}/{path}")
    stored = spark.read.parquet(f"{root}/{path}")
    version = table_version(stored).first()["version"]
    reason = audit(stored).agg(F.min(F.to_json(F.struct("*"))).alias("reason")).first()["reason"]
    entry = spark.range(1).select(
        F.current_timestamp().alias("at"), F.lit(version).alias("version"), F.lit(path).alias("path"),
        F.lit(reason is None).alias("accepted"), F.lit(reason).cast("string").alias("reason"))
    entry.write.mode("append").parquet(f"{root}/log")
    return version, reason is None


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """Every attempt: at, version, path, accepted, reason."""
    return spark.read.parquet(f"{root}/log")


def _current(spark: SparkSession, root: str):
    newest = F.max_by(F.struct("version", "path"), F.struct("at", "path"))
    return read_log(spark, root).filter("accepted").agg(newest.alias("c")).first()["c"]


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version last accepted."""
    current = _current(spark, root)
    return None if current is None else current["version"]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    current = _current(spark, root)
    if current is None:
        raise ValueError("no version has been accepted")
    return spark.read.parquet(f"{root}/{current['path']}")
