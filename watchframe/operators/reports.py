"""Report sections and their payload. Extension tier: our own definitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchframe.operators.probes import union
from watchframe.operators.quantiles import exact_quantiles


def period_delta(df: DataFrame, keys: Sequence[str], ts: str, split: Column, start: Column, end: Column,
                 measures: Mapping[str, Column]) -> DataFrame:
    """Every measure before and after ``split`` and their difference, in one pass over the rows."""
    span = df.filter((F.col(ts) >= start) & (F.col(ts) < end))
    is_current = F.col(ts) >= split
    aggs = []
    for name, c in measures.items():
        aggs.append(F.sum(F.when(is_current, c).otherwise(0)).alias(f"{name}_current"))
        aggs.append(F.sum(F.when(~is_current, c).otherwise(0)).alias(f"{name}_previous"))
    out = span.groupBy(*keys).agg(*aggs)
    for name in measures:
        out = out.withColumn(f"{name}_delta", F.col(f"{name}_current") - F.col(f"{name}_previous"))
    return out


def health_summary(events: DataFrame, keys: Sequence[str], is_error: Column) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count(F.when(is_error, 1)).alias("n_errors"),
        F.avg(F.when(is_error, 1.0).otherwise(0.0)).alias("error_ratio"))


def top_n(df: DataFrame, keys: Sequence[str], measure: str, tie_break: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` largest rows per key, or of all rows without keys, with their rank."""
    order = [F.col(measure).desc(), *[F.col(c) for c in tie_break]]
    if not keys:
        # a sorted limit keeps n rows per task, so the final rank sees no more than n rows
        df = df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def top_regressions(deltas: DataFrame, keys: Sequence[str], measure: str, tie_break: Sequence[str], n: int = 5) -> DataFrame:
    return top_n(deltas.filter(F.col(measure) > 0), keys, measure, tie_break, n)


def alert_noise(alert_events: DataFrame, keys: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """How often each alert fired and for how long."""
    return alert_events.groupBy(*keys).agg(
        F.count("*").alias("n_fired"), F.sum(F.col("resolved_s") - F.col("started_s")).alias("firing_s"))


def slo_delta(vector: DataFrame, keys: Sequence[str], target: float, value: str = "value") -> DataFrame:
    """Availability over all steps against its target."""
    return vector.groupBy(*keys).agg(F.avg(value).alias("ratio"), F.count("*").alias("n_steps")).withColumn(
        "delta", F.col("ratio") - F.lit(target))


def section(
    df: DataFrame, application: Column, section_id: str, title: str, columns: Sequence[str], order: Sequence[Column] = (), n: int = 100,
) -> DataFrame:
    """The first ``n`` rows of each application in one section as JSON, one row per entry.

    A section is a top list: ``order`` ranks its rows, the shown ``columns`` do where it is left out or ties. So what a payload
    gathers is bounded.
    """
    place = F.row_number().over(Window.partitionBy(application).orderBy(*order, *columns))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).select(
        application.alias("application_id"), F.lit(section_id).alias("id"), F.lit(title).alias("title"),
        F.to_json(F.struct(*columns)).alias("entry"))


def report_payload(sections: Sequence[DataFrame], start: str, end: str) -> DataFrame:
    """One payload per application. Sections come from ``section``, which bounds their rows."""
    data = F.array_sort(F.collect_list("entry"))
    per_section = union(sections).groupBy("application_id", "id", "title").agg(data.alias("entries"))
    body = F.struct("id", "title", F.parse_json(F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]"))).alias("data"))
    per_section = per_section.select("application_id", body.alias("section"), "id")
    gathered = per_section.groupBy("application_id").agg(F.collect_list(F.struct("id", F.to_json("section").alias("text"))).alias("s"))
    texts = F.transform(F.array_sort("s"), lambda x: x["text"])
    payload = F.concat(
        F.lit('{"application_id":'), F.regexp_replace(F.to_json(F.array("application_id")), r"^\[|\]$", ""),
        F.lit(f',"period":{{"start":"{start}","end":"{end}"}},"sections":['), F.array_join(texts, ","), F.lit("]}"))
    return gathered.select("application_id", payload.alias("payload"))


def due_runs(schedules: DataFrame, due: DataFrame) -> DataFrame:
    """Runs to queue: enabled schedules that an outside clock lists as due."""
    wanted = due.select("schedule_id", "time_start", "time_end").dropDuplicates(["schedule_id", "time_start", "time_end"])
    on = schedules.filter("enabled").select(F.col("id").alias("schedule_id"), "application_id", "report_template_id")
    return on.join(wanted, "schedule_id").withColumn("status", F.lit("queued"))


def collector_health(probe_runs: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """Runs, failures, latency and age of the newest run.

    ``probe_runs``: keys, started_at, latency_ms, ok.
    """
    counts = probe_runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"),
        (F.unix_seconds(now) - F.unix_seconds(F.max("started_at"))).alias("age_s"))
    latency = exact_quantiles(probe_runs, keys, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n")
    latency = latency.select(*[F.col(k).alias(f"l_{k}") for k in keys], "p50_ms", "p95_ms")
    same = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]
    return counts.join(latency, same, "left").drop(*[f"l_{k}" for k in keys])
