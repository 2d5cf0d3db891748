"""Adaptive baselines and hybrid alerts. Extension tier: the definitions here are our own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from watchframe.operators.islands import gap_to_previous
from watchframe.operators.quantiles import exact_quantiles, median_and_mad

MAD_SCALE = 1.4826


def mad_band(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Median plus and minus ``k`` scaled median absolute deviations."""
    margin = F.col("mad") * (k * MAD_SCALE)
    return median_and_mad(df, keys, value).withColumn("lower", F.col("median") - margin).withColumn("upper", F.col("median") + margin)


def quantile_band(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return exact_quantiles(df, keys, value, {"lower": low, "upper": high})


def bucket_means(df: DataFrame, keys: Sequence[str], value: str, bucket_s: int, ts: str = "ts") -> DataFrame:
    """Mean per key and time bucket (epoch seconds)."""
    bucket = F.unix_seconds(ts) - F.pmod(F.unix_seconds(ts), F.lit(bucket_s))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.avg(value).alias("mean"))


def ewma_deviation(means: DataFrame, keys: Sequence[str], alpha: float = 0.3) -> DataFrame:
    """Smoothed mean of all buckets so far and the distance of the newest one from it.

    Works on bucket means, so a key has one row per bucket of the time covered, however many samples it had.
    """
    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", ignore_index=True)
        return pdf.assign(ewma=pdf["mean"].ewm(alpha=alpha, adjust=False).mean())

    columns = [*keys, "bucket", "mean"]
    rows = means.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*keys).applyInPandas(smooth, f"{kinds}, ewma double").withColumn("deviation", F.col("mean") - F.col("ewma"))


def seasonal_baseline(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Mean and deviation per key, day of week (1 = Monday) and hour of day."""
    return df.groupBy(*keys, (F.weekday(ts) + 1).alias("dow"), F.hour(ts).alias("hour")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def baseline_rows(band: DataFrame, application_id: Column, signal_key: Column, window: str, method: str,
                  parameters: Sequence[str], computed_at: Column) -> DataFrame:
    """Baselines in the shape of the stored table, with the parameters as JSON."""
    return band.select(
        application_id.alias("application_id"), signal_key.alias("signal_key"), F.lit(window).alias("window"),
        F.lit(method).alias("method"), F.to_json(F.struct(*parameters)).alias("parameters"),
        computed_at.alias("last_computed_at"))


def hybrid_breaches(
    df: DataFrame, band: DataFrame, keys: Sequence[str], value: str, hard_limit: float, spread: int = 64,
) -> DataFrame:
    """Rows over the fixed limit or outside their key's upper bound; ``cause`` tells which.

    ``band`` has one row per key. Where it is not broadcast, the rows of a key are dealt over ``spread`` copies of its bound by a
    hash of their columns, so few keys still make many tasks.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    bound = band.select(*[F.col(k).alias(f"b_{k}") for k in keys], "upper", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("b_part"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(spread)).cast("int"))
    same = [F.col("_part") == F.col("b_part"), *[F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]]
    joined = dealt.join(bound, same, "left").drop("_part", "b_part", *[f"b_{k}" for k in keys])
    static, adaptive = F.col(value) > hard_limit, F.col(value) > F.col("upper")
    cause = F.when(static, F.lit("static")).when(adaptive, F.lit("adaptive"))
    return joined.withColumn("cause", cause).filter(F.col("cause").isNotNull())


def apply_cooldown(alerts: DataFrame, keys: Sequence[str], cooldown_s: int, started: str = "started_s") -> DataFrame:
    """Alerts that start at least ``cooldown_s`` after the one before them."""
    spaced = gap_to_previous(alerts, keys, started, cooldown_s, max(cooldown_s, 86_400))
    return spaced.filter(F.col("gap").isNull()).drop("gap")


def stored_parameters(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Typed columns back from stored baseline parameters."""
    ddl = ", ".join(f"{n} {t}" for n, t in names.items())
    return rows.withColumn("p", F.from_json("parameters", ddl)).select("*", "p.*").drop("p", "parameters")
