"""Exact quantiles per group when one group may hold a large share of all rows.

The built-in exact percentile gathers all distinct values of a group in one buffer. Here values are
first counted, then located by a coarse bucket that grows with the value and by a part of it, so only the
parts that hold a wanted rank are ever ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS_PER_OCTAVE = 256
_OFFSET = 300_000  # keeps the bucket number of the smallest double positive


_INFINITE, _NOT_A_NUMBER = 1 << 40, 1 << 41
FINE = 65_536  # parts of equal width that a bucket is cut into


def value_bucket(value: Column) -> Column:
    """Whole number that never falls as the value grows; about 0.3 % wide.

    Infinite values have a bucket of their own at either end, and NaN, which sorts after all numbers, has the last.
    """
    size = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + _OFFSET
    endless = F.abs(value) == float("inf")
    size = F.when(endless, F.lit(_INFINITE)).otherwise(F.when(~endless, size))
    finite = F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)
    return F.when(F.isnan(value), F.lit(_NOT_A_NUMBER)).otherwise(F.when(~F.isnan(value), finite))


def _fine(value: Column, bucket: Column) -> Column:
    """Place of a value within its bucket, so that values close together do not meet in one ordered run."""
    octave = (F.abs(bucket) - _OFFSET) / F.lit(float(BUCKETS_PER_OCTAVE))
    inside = F.log2(F.abs(value)) - octave
    place = F.floor(inside * (BUCKETS_PER_OCTAVE * FINE))
    return F.when((bucket == 0) | (F.abs(bucket) >= _INFINITE), F.lit(0).cast("long")).when(value > 0, place).otherwise(-place)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(
        F.count("*").alias("weight"))


def weighted_quantiles(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles of counted values: ``keys``, ``n`` and one column per entry of ``probs``."""
    keys = list(keys)
    counts = counts.withColumn("bucket", value_bucket(F.col("value"))).withColumn("part", _fine(F.col("value"), F.col("bucket")))
    sizes = counts.groupBy(*keys, "bucket").agg(F.sum("weight").alias("weight"))
    in_key = Window.partitionBy(*keys)
    ranked = sizes.withColumn("upto", F.sum("weight").over(in_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("n", F.sum("weight").over(in_key)).withColumn("before", F.col("upto") - F.col("weight"))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for name, p in probs.items()])
    spots = ranked.select(*keys, "bucket", "before", "upto", "n", F.inline(wanted))
    low, high = F.floor("at"), F.ceil("at")

    def holding(rows: DataFrame) -> DataFrame:
        """Rows of a run of ranks that holds a wanted one."""
        return rows.filter(((low >= F.col("before")) & (low < F.col("upto"))) | ((high >= F.col("before")) & (high < F.col("upto"))))

    def within(spots: DataFrame, at: Sequence[str]) -> DataFrame:
        """Counted values at the spots, with what the spots know."""
        named = spots.select(*[F.col(c).alias(f"s_{c}") for c in [*keys, *at]], "before", "n", "name", "at")
        same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*keys, *at]]
        return counts.join(named, same).select(*keys, "bucket", "part", "value", "weight", "before", "n", "name", "at")

    # the same search once more inside a bucket, by parts of it
    parts = within(holding(spots), ["bucket"]).groupBy(*keys, "bucket", "part", "before", "n", "name", "at").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy(*keys, "bucket", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.col("before") + F.sum("weight").over(order)).withColumn("before", F.col("upto") - F.col("weight"))
    joined = within(holding(parts), ["bucket", "part"])
    order = Window.partitionBy(*keys, "bucket", "part", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("upto", F.col("before") + F.sum("weight").over(order))
    ends = placed.groupBy(*keys, "n", "name", "at").agg(
        F.min(F.when(F.col("upto") > low, F.col("value"))).alias("v0"),
        F.min(F.when(F.col("upto") > high, F.col("value"))).alias("v1"))
    share = F.col("at") - F.floor("at")
    point = F.when(share == 0, F.col("v0")).otherwise(F.col("v0") * (1 - share) + F.col("v1") * share)
    return ends.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, point)).alias(name) for name in probs])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    return weighted_quantiles(value_counts(df, keys, value), keys, probs)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and raw median absolute deviation per group: ``keys``, ``n``, ``median``, ``mad``."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    medians = weighted_quantiles(counts, keys, {"median": 0.5})
    m = medians.select(*[F.col(k).alias(f"m_{k}") for k in keys], "median")
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    spread = counts.join(m, same).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"), "weight")
    deviations = weighted_quantiles(spread, keys, {"mad": 0.5}).select(*[F.col(k).alias(f"m_{k}") for k in keys], "mad")
    return medians.join(deviations, same).select(*keys, "n", "median", "mad")
