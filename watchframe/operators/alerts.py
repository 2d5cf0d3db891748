"""Alert hold, event folding, annotation and grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from watchframe.functions.labels import fingerprint
from watchframe.functions.text import fill_label_template
from watchframe.functions.timeparse import ceil_div
from watchframe.operators.islands import islands
from watchframe.operators.rules import STEP_SECONDS

HOLD_SECONDS = 120  # fixed value: how long a condition holds before its alert fires
# Fixed value: grouping labels.
GROUP_BY = ("alertname", "job", "environment")


def active_intervals(
    true_steps: DataFrame, series: Sequence[str], step_s: int = STEP_SECONDS, hold_s: int = HOLD_SECONDS,
    chunk_steps: int = 2400,
) -> DataFrame:
    """Runs of consecutive true steps: ``active_from``, ``active_to`` and ``firing_from`` (NULL if never firing).

    A false or missing step ends a run. All in epoch seconds.
    """
    runs = islands(true_steps, series, "step", step_s, chunk_steps * step_s)
    fires = F.col("start") + hold_s
    return runs.select(
        *series, F.col("start").alias("active_from"), F.col("end").alias("active_to"),
        F.when(fires <= F.col("end"), ceil_div(fires, step_s) * step_s).alias("firing_from"))


def alert_states(intervals: DataFrame, series: Sequence[str], step_s: int = STEP_SECONDS) -> DataFrame:
    """State per step, ``pending`` or ``firing``; steps without a row are inactive."""
    steps = intervals.select(
        *series, "active_from", "firing_from",
        F.explode(F.sequence(F.col("active_from"), F.col("active_to"), F.lit(step_s).cast("long"))).alias("step"))
    state = F.when(F.col("step") >= F.col("firing_from"), F.lit("firing")).otherwise(F.lit("pending"))
    return steps.select(*series, "step", state.alias("state"), "active_from")


def alert_events(
    intervals: DataFrame, series: Sequence[str], alertname: str, severity: str, eval_end: int,
    step_s: int = STEP_SECONDS,
) -> DataFrame:
    """One event per firing run. It resolves at the first evaluation that is no longer true."""
    ended = F.when(F.col("active_to") + step_s <= eval_end, F.col("active_to") + step_s)
    fired = intervals.filter(F.col("firing_from").isNotNull())
    return fired.select(
        F.lit(alertname).alias("alertname"), F.lit(severity).alias("severity"), *series,
        fingerprint(series, F.lit(alertname)).alias("fingerprint"),
        F.col("firing_from").alias("started_s"), ended.alias("resolved_s"),
        F.when(ended.isNull(), F.lit("firing")).otherwise(F.lit("resolved")).alias("status"))


def annotate(events: DataFrame, templates: Mapping[str, str], labels: Sequence[str]) -> DataFrame:
    """Add one filled text column per annotation template."""
    values = {name: F.col(name) for name in labels}
    return events.select("*", *[fill_label_template(F.lit(t), values).alias(name) for name, t in templates.items()])


def alert_groups(events: DataFrame, group_by: Sequence[str] = GROUP_BY) -> DataFrame:
    """Size and span of each notification group. The member alerts stay rows of ``events``."""
    return events.groupBy(*group_by).agg(
        F.count("*").alias("n_alerts"),
        F.countDistinct("fingerprint").alias("n_fingerprints"),
        F.count(F.when(F.col("status") == "firing", 1)).alias("n_firing"),
        F.min("started_s").alias("first_started_s"),
        F.max("resolved_s").alias("last_resolved_s"))
