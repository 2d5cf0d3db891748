"""Sample identity, last-value and label-set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.functions.labels import label_names, label_text

LABEL_ENTRIES = "array<struct<key:string,value:string>>"


def arrival(ts: Column, ord_: Column) -> Column:
    """Arrival order as one decimal.

    A decimal fits a hash-aggregation buffer; a struct of both would force a sort of the whole input.
    """
    return F.unix_micros(ts).cast("decimal(19,0)") * F.expr("cast('10000000000000000000' as decimal(20,0))") + ord_.cast("decimal(19,0)")


def keyed(samples: DataFrame) -> DataFrame:
    """Samples with the label map replaced by its sorted text ``series``."""
    return samples.select("metric", label_text(F.col("labels")).alias("series"), "ts", "ord", "value")


def labels_of(series: Column) -> Column:
    """The label map back from its sorted text."""
    return F.map_from_entries(F.from_json(series, LABEL_ENTRIES))


def latest(samples: DataFrame) -> DataFrame:
    """The last value of every series: newest ``ts``, then highest ``ord``."""
    last = keyed(samples).groupBy("metric", "series").agg(
        F.max_by("value", arrival(F.col("ts"), F.col("ord"))).alias("value"), F.max("ts").alias("ts"))
    return last.select("metric", labels_of(F.col("series")).alias("labels"), "ts", "value")


def last_value(samples: DataFrame) -> DataFrame:
    """The last value of every metric, whatever its labels."""
    return samples.groupBy("metric").agg(F.max_by("value", arrival(F.col("ts"), F.col("ord"))).alias("value"))


def lookup_last_value(requested: DataFrame, samples: DataFrame) -> DataFrame:
    """Last value per requested ``metric``, 0 when it was never recorded."""
    found = requested.select("metric").distinct().join(last_value(samples), "metric", "left")
    return found.select("metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def metric_help(samples: DataFrame) -> DataFrame:
    """Help text fixed by the first sample of a metric, the metric name when blank."""
    texts = samples.groupBy("metric", "help").agg(F.min(arrival(F.col("ts"), F.col("ord"))).alias("first_seen"))
    first = texts.groupBy("metric").agg(F.min_by("help", "first_seen").alias("help"))
    return first.select("metric", F.coalesce(F.nullif("help", F.lit("")), "metric").alias("help"))


def label_set_violations(samples: DataFrame) -> DataFrame:
    """Label-name sets that differ from the first one seen for their metric.

    Samples collapse to one row per metric and name set before any comparison.
    """
    order = arrival(F.col("ts"), F.col("ord"))
    sets = samples.groupBy("metric", label_names(F.col("labels")).alias("label_names")).agg(
        F.min(order).alias("first_seen"), F.count("*").alias("n_samples"))
    expected = sets.groupBy("metric").agg(F.min_by("label_names", "first_seen").alias("expected_names"))
    return (
        sets.join(expected, "metric").filter(F.col("label_names") != F.col("expected_names"))
        .select("metric", "expected_names", "label_names", "n_samples")
    )


def label(labels: Column, name: str) -> Column:
    """A label's value, '' when the series does not carry it."""
    return F.coalesce(labels[name], F.lit(""))


def last_not_null(samples: DataFrame, keys: Sequence[str], now: Column, hours: int = 1, value: str = "value") -> DataFrame:
    """Newest non-null value per key within the last ``hours``: the reduction of a stat panel."""
    window = samples.filter(
        F.col(value).isNotNull() & (F.col("ts") <= now) & (F.col("ts") >= now - F.expr(f"INTERVAL {int(hours)} HOURS")))
    order = arrival(F.col("ts"), F.col("ord")) if "ord" in samples.columns else F.col("ts")
    return window.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max("ts").alias("ts"))
