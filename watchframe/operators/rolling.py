"""Baselines over trailing windows of time buckets. Extension tier: the definition here is our own.

Values are counted once, per key, bucket and cell of values about 0.3 % wide. These counted histograms are mergeable: a window's
is the one before it with the entering bucket added and the leaving one subtracted, and a rank is found on its prefix sums. So
a window costs its two changed buckets and the cells, not its rows. What the cells cannot tell, the value at a rank, is then
looked up among the counted values of the one or two cells that hold it; the same for the deviations from a window's median,
whose rank a few cells around it hold. Nothing is approximated.

A key's buckets are cut into chunks, and a histogram goes on to the chunks whose windows still hold it, so a key with a third of
all rows spreads over its chunks; a chunk holds histograms of cells, whose number does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchframe.functions.timeparse import floor_div
from watchframe.operators.baselines import MAD_SCALE
from watchframe.operators.quantiles import value_bucket

CHUNK = 64  # buckets whose windows one task slides over


def _same(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


def _named(df: DataFrame, keys: Sequence[str], prefix: str, *rest: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *rest)


def counted(df: DataFrame, keys: Sequence[str], value: str, bucket_s: int, ts: str = "ts") -> DataFrame:
    """Counted finite values per key and time bucket: ``keys``, ``at`` (number of the bucket), ``cell``, ``value``, ``weight``."""
    number = F.col(value).cast("double")
    kept = df.select(*keys, floor_div(F.unix_seconds(ts), bucket_s).alias("at"), number.alias("value"))
    kept = kept.filter(F.abs("value") < float("inf"))
    rows = kept.groupBy(*keys, "at", (F.col("value") + 0.0).alias("value")).agg(F.count("*").alias("weight"))
    return rows.select(*keys, "at", value_bucket(F.col("value")).alias("cell"), "value", "weight")


def histograms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key, bucket and cell, with the cell's least and greatest value."""
    return counts.groupBy(*keys, "at", "cell").agg(F.sum("weight").alias("weight"), F.min("value").alias("low"), F.max("value").alias("high"))


class _Windows:
    """The histogram of each bucket's trailing window, slid over one chunk of one key."""

    def __init__(self, rows: pd.DataFrame, chunk: int, chunk_width: int, window: int):
        cells = rows.groupby("cell").agg(low=("low", "min"), high=("high", "max"))
        self.cells, self.low, self.high = cells.index.to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy()
        place = np.searchsorted(self.cells, rows["cell"].to_numpy())
        self.entries = {at: (place[index], rows["weight"].to_numpy()[index]) for at, index in rows.groupby("at").indices.items()}
        self.first, self.last, self.window = chunk * chunk_width, (chunk + 1) * chunk_width, window

    def __iter__(self):
        """Each bucket of the chunk that has rows, and the counts of its window's cells."""
        counts = np.zeros(len(self.cells), np.int64)
        for at in range(self.first - self.window + 1, self.last):
            if at in self.entries:
                np.add.at(counts, *self.entries[at])
            if at - self.window in self.entries and at - self.window >= self.first - self.window + 1:
                np.subtract.at(counts, *self.entries[at - self.window])
            if at >= self.first and at in self.entries:
                yield at, counts


def _spots(keys: Sequence[str], rows: DataFrame, told: DataFrame | None, window: int, chunk_width: int) -> DataFrame:
    """Cells that hold the middle ranks of each window: ``keys``, ``at``, ``n``, ``cell``, ``before`` (values below the first of these
    cells), ``first`` and ``second`` rank. With ``told``, medians of the windows, ranks of the distances from them.
    """
    chunk = floor_div(F.col("at"), chunk_width)
    until = floor_div(F.col("at") + (window - 1), chunk_width)
    spread = rows.withColumn("chunk", F.explode(F.sequence(chunk, until)))
    names = [*keys, "at", "n", "cell", "before", "first", "second"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = (f"{kinds}, " if keys else "") + "at long, n long, cell long, before long, first long, second long"

    def walk(pdf: pd.DataFrame, medians: dict | None) -> pd.DataFrame:
        out, key = [], [pdf[k].iloc[0] for k in keys]
        windows = _Windows(pdf, int(pdf["chunk"].iloc[0]), chunk_width, window)
        for at, counts in windows:
            n = int(counts.sum())
            first, second = (n - 1) // 2, n // 2
            there = np.flatnonzero(counts)
            weight = counts[there]
            if medians is None:
                upto = np.cumsum(weight)
                held = np.unique(np.searchsorted(upto, [first, second], "right"))
                before = int(upto[held[0]] - weight[held[0]])
            else:
                low, high, middle = windows.low[there], windows.high[there], medians[at]
                ends = np.abs(np.stack([low, high]) - middle)
                nearest, farthest = np.where((low <= middle) & (middle <= high), 0, ends.min(axis=0)), ends.max(axis=0)
                # no distance of these ranks is below the one or above the other
                least, most = _ranked(nearest, weight, first), _ranked(farthest, weight, second)
                held = np.flatnonzero((farthest >= least) & (nearest <= most))
                before = int(weight[farthest < least].sum())
            out += [(*key, at, n, int(windows.cells[there[i]]), before, first, second) for i in held]
        return pd.DataFrame(out, columns=names)

    if told is None:
        return spread.groupBy(*keys, "chunk").applyInPandas(lambda pdf: walk(pdf, None), schema)

    def both(pdf: pd.DataFrame, medians: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or medians.empty:
            return pd.DataFrame([], columns=names)
        return walk(pdf, dict(zip(medians["at"], medians["middle"])))

    middles = told.select(*[F.col(k).alias(f"m_{k}") for k in keys], "at", "middle", chunk.alias("m_chunk"))
    return spread.groupBy(*keys, "chunk").cogroup(middles.groupBy(*[f"m_{k}" for k in keys], "m_chunk")).applyInPandas(both, schema)


def _ranked(distance: np.ndarray, weight: np.ndarray, rank: int) -> float:
    order = np.argsort(distance, kind="stable")
    return distance[order][np.searchsorted(np.cumsum(weight[order]), rank, "right")]


def _at_ranks(keys: Sequence[str], counts: DataFrame, spots: DataFrame, window: int, middles: DataFrame | None) -> DataFrame:
    """Mean of the values, or distances, at the two middle ranks: ``keys``, ``at``, ``n``, ``middle``."""
    cells = _named(spots, keys, "c_", F.col("cell").alias("c_cell")).distinct()
    near = counts.join(cells, [*_same(keys, "c_"), F.col("cell") == F.col("c_cell")], "left_semi")
    near = near.withColumn("window", F.explode(F.sequence(F.col("at"), F.col("at") + (window - 1)))).drop("at")
    named = _named(spots, keys, "s_", "at", "n", F.col("cell").alias("s_cell"), "before", "first", "second")
    met = near.join(named, [*_same(keys, "s_"), F.col("cell") == F.col("s_cell"), F.col("window") == F.col("at")])
    point = F.col("value")
    if middles is not None:
        met = met.select(*keys, "at", "n", "before", "first", "second", "value", "weight").join(
            _named(middles, keys, "m_", F.col("at").alias("m_at"), "middle"), [*_same(keys, "m_"), F.col("at") == F.col("m_at")])
        point = F.abs(F.col("value") - F.col("middle"))
    points = met.groupBy(*keys, "at", "n", "before", "first", "second", point.alias("point")).agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy(*keys, "at").orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    upto = points.withColumn("upto", F.col("before") + F.sum("weight").over(order))
    ends = upto.groupBy(*keys, "at", "n").agg(
        F.min(F.when(F.col("upto") > F.col("first"), F.col("point"))).alias("one"),
        F.min(F.when(F.col("upto") > F.col("second"), F.col("point"))).alias("two"))
    return ends.select(*keys, "at", "n", ((F.col("one") + F.col("two")) / 2).alias("middle"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rolling_mad(df: DataFrame, keys: Sequence[str], value: str, bucket_s: int, window: int, folder: str, k: float = 3.0, ts: str = "ts",
                chunk_width: int = CHUNK) -> DataFrame:
    """Per key and time bucket that has values: ``n``, ``median``, raw ``mad``, ``lower`` and ``upper`` over the ``window`` buckets that
    end with it. ``bucket`` is its start in epoch seconds. NULL keys are one key; NULL, NaN and infinite values do not count.
    ``folder`` is shared and new: counts, histograms and medians are read several times and kept there.
    """
    keys = list(keys)
    counts = _stored(counted(df, keys, value, bucket_s, ts), f"{folder}/counts")
    rows = _stored(histograms(counts, keys), f"{folder}/histograms")
    spots = _stored(_spots(keys, rows, None, window, chunk_width), f"{folder}/spots")
    medians = _stored(_at_ranks(keys, counts, spots, window, None), f"{folder}/medians")
    spots = _stored(_spots(keys, rows, medians, window, chunk_width), f"{folder}/distances")
    deviations = _at_ranks(keys, counts, spots, window, medians)
    mads = _named(deviations, keys, "d_", F.col("at").alias("d_at"), F.col("middle").alias("mad"))
    joined = medians.join(mads, [*_same(keys, "d_"), F.col("at") == F.col("d_at")])
    margin = F.col("mad") * (k * MAD_SCALE)
    return joined.select(*keys, (F.col("at") * bucket_s).alias("bucket"), "n", F.col("middle").alias("median"), "mad",
                         (F.col("middle") - margin).alias("lower"), (F.col("middle") + margin).alias("upper"))
