"""Mergeable quantile sketches of time buckets, for bands over any span at a scale where exact ones cost too much.

A sketch (KLL) holds a bounded number of values whatever it has seen. One is kept per key and bucket of time; those of a span
are merged, so no row is read again for another span. Quantiles are approximate: with the default size the rank of a result
is off by at most ``RANK_ERROR`` of all rows with 99 % confidence, also after merging. ``quantiles`` has the exact ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from watchframe.functions.timeparse import floor_div

SIZE = 200  # values kept per level
RANK_ERROR = 0.0165


def bucket_sketches(df: DataFrame, keys: Sequence[str], value: str, bucket_s: int, ts: str = "ts", size: int = SIZE) -> DataFrame:
    """One sketch per key and bucket of time (``bucket``, epoch seconds): a partial one per task, merged after the shuffle.

    Rows without a value or a time, and NaN, are left out.
    """
    us = F.unix_micros(ts)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(ts).isNotNull())
    bucket = floor_div(us, bucket_s * 1_000_000) * bucket_s
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"), F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches united per key. What is stored by hour serves days, weeks or all time."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def trailing(sketches: DataFrame, keys: Sequence[str], bucket_s: int, buckets: int) -> DataFrame:
    """For every key and bucket that has rows, the sketch of that bucket and the ``buckets - 1`` before it.

    A bucket's sketch is copied to the windows that hold it, and copies are merged as sketches of bounded size.
    """
    width = F.lit(bucket_s).cast("long")
    ends = F.sequence(F.col("bucket"), F.col("bucket") + width * (buckets - 1), width)
    copies = sketches.withColumnRenamed("bucket", "_from").withColumn("bucket", F.col("_from"))
    copies = copies.withColumn("bucket", F.explode(ends)).withColumn("_own", F.col("bucket") == F.col("_from"))
    spans = copies.groupBy(*keys, "bucket").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.max("_own").alias("_own"))
    return spans.filter("_own").drop("_own")


def sketch_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """A column per entry of ``probs`` in place of the sketch."""
    columns = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *columns)


def sketch_band(df: DataFrame, keys: Sequence[str], value: str, bucket_s: int, low: float = 0.05, high: float = 0.95,
                ts: str = "ts", size: int = SIZE) -> DataFrame:
    """``baselines.quantile_band`` from sketches: ``keys``, ``n``, ``lower`` and ``upper``."""
    return sketch_quantiles(merged(bucket_sketches(df, keys, value, bucket_s, ts, size), keys), {"lower": low, "upper": high})
