"""Sweep lines: totals that rise and fall along time, of keys of any size.

Changes are first added up per key and instant. A key's instants are cut into chunks of time; the sums of whole chunks are few and
are added up in order, and an instant's total is that of the chunks before plus the changes of its own chunk up to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from watchframe.functions.timeparse import floor_div
from watchframe.operators.islands import islands

CHUNK_SECONDS = 86_400


def running_totals(changes: DataFrame, keys: Sequence[str], at: str, amounts: Sequence[str], chunk_s: int = CHUNK_SECONDS) -> DataFrame:
    """One row per key and instant of ``changes``: the totals of ``amounts`` after all its changes."""
    instants = changes.groupBy(*keys, at).agg(*[F.sum(a).alias(a) for a in amounts]).withColumn("_chunk", floor_div(F.col(at), chunk_s))
    chunks = instants.groupBy(*keys, "_chunk").agg(*[F.sum(a).alias(a) for a in amounts])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    borders = chunks.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_chunk").alias("_b_chunk"),
                            *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_b_{a}") for a in amounts])
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys] + [F.col("_chunk") == F.col("_b_chunk")]
    own = Window.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return instants.join(borders, same).select(*keys, at, *[(F.col(f"_b_{a}") + F.sum(a).over(own)).alias(a) for a in amounts])


def correlated_signals(alerts: DataFrame, keys: Sequence[str], window_s: int, signal: str, at_least: int = 2,
                       started: str = "started_s", chunk_s: int = CHUNK_SECONDS) -> DataFrame:
    """Instants at which an alert started and ``at_least`` different signals had alerted for its key within the ``window_s`` seconds
    up to it: ``keys``, ``at_s``, ``n_signals`` and ``n_alerts`` of that window.

    An alert counts from its start until the window has passed. Starts of one signal that follow each other within a window are
    one stretch, so a signal is counted once however often it alerts: the line rises where a stretch begins and falls where it ends.
    """
    starts = alerts.groupBy(*keys, signal, F.col(started).alias("_at")).agg(F.count("*").alias("_n"))
    stretches = islands(starts.drop("_n"), [*keys, signal], "_at", window_s, max(chunk_s, window_s))

    def change(df: DataFrame, at, signals: int, n) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select(*keys, at.alias("at_s"), (zero + signals).alias("n_signals"), (zero + n).alias("n_alerts"))

    changes = (
        change(stretches, F.col("start"), 1, 0).unionByName(change(stretches, F.col("end") + window_s, -1, 0))
        .unionByName(change(starts, F.col("_at"), 0, F.col("_n"))).unionByName(change(starts, F.col("_at") + window_s, 0, -F.col("_n"))))
    totals = running_totals(changes, keys, "at_s", ["n_signals", "n_alerts"], chunk_s)
    begins = starts.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_at").alias("_s_at")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col("at_s") == F.col("_s_at")]
    return totals.filter(F.col("n_signals") >= at_least).join(begins, same, "left_semi")
