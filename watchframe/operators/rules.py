"""Recording rules over samples: instant selection, counter rates and label aggregation.

Both selections work on a grid of evaluation steps. A series is cut into chunks of steps and a
sample is copied into each chunk it can be seen from (its own, and the next one when it lies
within the look-back of the border), so every chunk is complete by itself: no carry between
chunks, and a dense series spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchframe.functions.timeparse import ceil_div, floor_div

STEP_SECONDS = 15  # fixed value: evaluation interval
LOOKBACK_SECONDS = 300
MICROS = 1_000_000


def _covered(
    samples: DataFrame, series: Sequence[str], value: str, window_s: int, step_s: int,
    start: int | None, end: int | None, order: str | None,
) -> DataFrame:
    """Samples with the first and last step whose window ``(t - window, t]`` holds them."""
    ts = F.col("ts")
    if start is not None:
        samples = samples.filter(ts > F.timestamp_seconds(F.lit(start - window_s)))
    if end is not None:
        samples = samples.filter(ts <= F.timestamp_seconds(F.lit(end)))
    us = F.unix_micros(ts)
    first, last = ceil_div(us, step_s * MICROS), ceil_div(us + window_s * MICROS, step_s * MICROS) - 1
    if start is not None:
        first = F.greatest(first, F.lit(-(-start // step_s)).cast("long"))
    if end is not None:
        last = F.least(last, F.lit(end // step_s).cast("long"))
    rows = samples.select(
        *series, us.alias("us"), F.struct(us.alias("us"), (F.col(order) if order else F.lit(0)).alias("order")).alias("at"),
        F.col(value).cast("double").alias("value"), first.alias("first"), last.alias("last"))
    return rows.filter(F.col("first") <= F.col("last"))


def _chunked(rows: DataFrame, chunk_steps: int) -> DataFrame:
    chunks = F.sequence(floor_div(F.col("first"), chunk_steps), floor_div(F.col("last"), chunk_steps))
    return rows.withColumn("chunk", F.explode(chunks))


def _clip(chunk_steps: int) -> tuple[Column, Column]:
    low = F.col("chunk") * chunk_steps
    return low, low + (chunk_steps - 1)


def instant_vector(
    samples: DataFrame, series: Sequence[str], value: str = "value", step_s: int = STEP_SECONDS,
    lookback_s: int = LOOKBACK_SECONDS, start: int | None = None, end: int | None = None, chunk_steps: int = 2400,
    order: str | None = None,
) -> DataFrame:
    """Newest sample per series at every step, as ``series``, ``step`` (epoch seconds) and ``value``.

    A series ends one look-back after its last sample. Of samples with equal ``ts`` the one last in the column ``order`` is
    taken; without such a column, remove repeats first.
    """
    rows = _covered(samples, series, value, lookback_s, step_s, start, end, order)
    # samples that become visible at the same step collapse to the newest before the wide shuffle
    return _spread(_chunked(_newest(rows, [*series, "first"]), chunk_steps), series, step_s, chunk_steps)


def _newest(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    return rows.groupBy(*cell).agg(F.max_by("value", "at").alias("value"), F.max("last").alias("last"))


def _spread(chunked: DataFrame, series: Sequence[str], step_s: int, chunk_steps: int) -> DataFrame:
    """Each newest sample over the steps up to the next one."""
    following = F.lead("first").over(Window.partitionBy(*series, "chunk").orderBy("first"))
    low, high = _clip(chunk_steps)
    spans = chunked.withColumn("following", following).select(
        *series, "value",
        F.greatest(F.col("first"), low).alias("lo"),
        F.least(F.col("last"), high, F.col("following") - 1).alias("hi"))
    width = F.lit(step_s).cast("long")
    steps = F.explode(F.sequence(F.col("lo") * width, F.col("hi") * width, width))
    return spans.filter(F.col("lo") <= F.col("hi")).select(*series, steps.alias("step"), "value")


def rate(
    samples: DataFrame, series: Sequence[str], value: str = "value", range_s: int = 300, step_s: int = STEP_SECONDS,
    start: int | None = None, end: int | None = None, chunk_steps: int = 480, order: str | None = None,
) -> DataFrame:
    """Per-second increase of a counter over the trailing range at every step.

    Resets are added back, the result is extrapolated to the window edges, and a window needs samples of two instants.
    Samples of one instant come in the order of the column ``order``. Columns: ``series``, ``step``, ``n``, ``increase``,
    ``rate``. Samples seen from the same steps form a cell and are reduced to its ends and what its resets hide; then only
    cells are ordered, in chunks. So a dense series spreads over its cells.
    """
    rows = _covered(samples, series, value, range_s, step_s, start, end, order)
    return _windows(_chunked(_cells(rows, [*series, "first", "last"]), chunk_steps), series, range_s, step_s, chunk_steps)


def _cells(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Samples seen from the same steps, reduced to their ends and what their resets hide."""
    previous = F.lag("value").over(Window.partitionBy(*cell).orderBy("at"))
    # what a reset hides: the value the counter had reached before it fell
    hidden = F.when(F.col("value") < F.col("previous"), F.col("previous")).otherwise(F.lit(0.0))
    return rows.withColumn("previous", previous).groupBy(*cell).agg(
        F.count("*").alias("n"), F.min("us").alias("us0"), F.max("us").alias("us1"),
        F.min_by("value", "at").alias("v0"), F.max_by("value", "at").alias("v1"), F.sum(hidden).alias("inside"))


def _windows(chunked: DataFrame, series: Sequence[str], range_s: int, step_s: int, chunk_steps: int) -> DataFrame:
    """Rates of the cells of each chunk."""
    before = F.lag("v1").over(Window.partitionBy(*series, "chunk").orderBy("us0"))
    parts = chunked.withColumn("before", before).withColumn(
        "drop0", F.when(F.col("v0") < F.col("before"), F.col("before")).otherwise(F.lit(0.0)))
    low, high = _clip(chunk_steps)
    steps = F.explode(F.sequence(F.greatest(F.col("first"), low), F.least(F.col("last"), high)))
    windows = parts.withColumn("k", steps).groupBy(*series, "chunk", "k").agg(
        F.sum("n").alias("n"), F.min("us0").alias("us0"), F.max("us1").alias("us1"),
        F.min_by("v0", "us0").alias("v0"), F.max_by("v1", "us1").alias("v1"),
        F.min_by("drop0", "us0").alias("drop0"), F.sum(F.col("inside") + F.col("drop0")).alias("drops"))
    # the drop at a window's first sample happened before the window
    increase = F.col("v1") - F.col("v0") + F.col("drops") - F.col("drop0")
    ready = windows.filter("us1 > us0").select(
        *series, (F.col("k") * step_s).alias("step"), "n", "us0", "us1", "v0", increase.alias("increase"))
    return ready.select(*series, "step", "n", "increase", (F.col("increase") * _extrapolation(range_s) / range_s).alias("rate"))


def stored_chunks(
    samples: DataFrame, series: Sequence[str], value: str = "value", reach_s: int = 300, step_s: int = STEP_SECONDS,
    start: int | None = None, end: int | None = None, chunk_steps: int = 480, order: str | None = None,
) -> DataFrame:
    """Samples as ``sinks.store_bucketed`` keeps them by series and chunk: each in every chunk of steps that can see it."""
    return _chunked(_covered(samples, series, value, reach_s, step_s, start, end, order), chunk_steps)


def rate_of_chunks(stored: DataFrame, series: Sequence[str], range_s: int = 300, step_s: int = STEP_SECONDS, chunk_steps: int = 480) -> DataFrame:
    """``rate`` over stored chunks, made with the same settings. Bucketed by series and chunk, they need no shuffle."""
    return _windows(_cells(stored, [*series, "chunk", "first", "last"]), series, range_s, step_s, chunk_steps)


def vector_of_chunks(stored: DataFrame, series: Sequence[str], step_s: int = STEP_SECONDS, chunk_steps: int = 480) -> DataFrame:
    """``instant_vector`` over stored chunks whose ``reach_s`` is the look-back. Bucketed by series and chunk, they need no shuffle."""
    return _spread(_newest(stored, [*series, "chunk", "first"]), series, step_s, chunk_steps)


def _extrapolation(range_s: int) -> Column:
    """Stretch of the sampled span to the window edges."""
    sampled = (F.col("us1") - F.col("us0")) / MICROS
    average = sampled / (F.col("n") - 1)
    to_start = F.col("us0") / MICROS - (F.col("step") - range_s)
    to_end = F.col("step") - F.col("us1") / MICROS
    to_start = F.when(to_start >= average * 1.1, average / 2).otherwise(to_start)
    to_zero = F.when((F.col("increase") > 0) & (F.col("v0") >= 0), sampled * F.col("v0") / F.col("increase"))
    to_start = F.least(to_start, to_zero)
    to_end = F.when(to_end >= average * 1.1, average / 2).otherwise(to_end)
    return (sampled + to_start + to_end) / sampled


def sum_by(vector: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return vector.groupBy("step", *by).agg(F.sum(value).alias("value"))


def avg_by(vector: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return vector.groupBy("step", *by).agg(F.avg(value).alias("value"))


def count_series(vector: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vector.groupBy("step", *by).agg(F.count("*").alias("value"))


def matches(c: Column, pattern: str) -> Column:
    """Regex match of the whole value."""
    return c.rlike(rf"\A(?s:{pattern})\z")


def threshold(vector: DataFrame, condition: Column | str) -> DataFrame:
    """Series and steps at which the condition holds."""
    return vector.filter(condition)
