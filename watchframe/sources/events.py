"""Raw JSON sources: one document per line, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_raw(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Continuous read of a folder; ``max_files_per_trigger`` bounds each batch."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
