"""Inventory documents and collector tables, read with their declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchframe.schemas import COLLECTORS, INVENTORY


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole inventory documents in JSON, one per file."""
    return spark.read.schema(INVENTORY).option("multiLine", True).json(path)


def read_documents(spark: SparkSession, path: str, keys: str = "document STRING") -> DataFrame:
    """Many inventory documents, one JSON text per line, with the columns that name them; files are split between tasks."""
    return spark.read.schema(f"{keys}, {INVENTORY}").json(path)


def read_collectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLECTORS).parquet(path)
