"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results, not for speed.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# The JVM never compiles a method over 8000 bytes of byte code, so a larger stage runs as separate operators.
CODEGEN = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Run-time re-planning: skewed joins are split and small partitions merged.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply what right results need to an existing session; tuning is left to whoever built it."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "watchframe", master: str | None = None, **conf: str) -> SparkSession:
    # recording a stack trace for every column call doubles the time it takes to build a plan
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **CODEGEN, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="watchframe-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

