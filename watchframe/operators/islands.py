"""Runs of neighbouring positions, computed so that no key is ever held by one task.

A key's positions are cut into chunks of fixed width. Runs are found inside each chunk; only
the first and the last run of a chunk can continue next door, so only those, at most two rows
per chunk, meet again to be joined up. A key with a third of all rows spreads over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchframe.functions.timeparse import floor_div


def _opens(start: Column, previous_end: Column, max_gap: int) -> Column:
    return F.when(start - previous_end <= max_gap, F.lit(0)).otherwise(F.lit(1))


def islands(
    df: DataFrame, keys: Sequence[str], position: str, max_gap: int, chunk_width: int, sums: Sequence[str] = ()
) -> DataFrame:
    """Merge positions no further than ``max_gap`` apart: ``keys``, ``start``, ``end``, ``n`` and ``sums``."""
    rows = df.select(*keys, *sums, F.col(position).alias("_pos")).withColumn("_chunk", floor_div(F.col("_pos"), chunk_width))
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    numbered = rows.withColumn("_open", _opens(F.col("_pos"), F.lag("_pos").over(in_chunk), max_gap)).withColumn(
        "_no", F.sum("_open").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "_chunk", "_no").agg(
        F.min("_pos").alias("start"), F.max("_pos").alias("end"), F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in sums])
    # inner runs get a slot of their own; the runs at chunk borders share one slot per key
    n_runs = F.max("_no").over(Window.partitionBy(*keys, "_chunk"))
    inner = (F.col("_no") > 1) & (F.col("_no") < F.col("_n_runs"))
    slotted = runs.withColumn("_n_runs", n_runs).select(
        *keys, "start", "end", "n", *sums,
        F.when(inner, F.col("_chunk")).alias("_slot"), F.when(inner, F.col("_no")).alias("_slot_no"))
    by_slot = Window.partitionBy(*keys, "_slot", "_slot_no").orderBy("start")
    joined = slotted.withColumn("_open", _opens(F.col("start"), F.lag("end").over(by_slot), max_gap)).withColumn(
        "_run", F.sum("_open").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "_slot", "_slot_no", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in sums],
    ).select(*keys, "start", "end", "n", *sums)


def gap_to_previous(df: DataFrame, keys: Sequence[str], position: str, reach: int, chunk_width: int) -> DataFrame:
    """Add ``gap``: distance to the previous row of the key, NULL when it is ``reach`` or more away.

    A row is copied to the next chunk when rows there can look back to it.
    """
    pos = F.col(position)
    home = floor_div(pos, chunk_width)
    copies = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.sequence(home, floor_div(pos + (reach - 1), chunk_width))))
    gap = pos - F.lag(position).over(Window.partitionBy(*keys, "_chunk").orderBy(position))
    own = copies.withColumn("gap", gap).filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")
    return own.withColumn("gap", F.when(F.col("gap") < reach, F.col("gap")))
