"""Database health probes: snapshot rows to labelled samples and evidence.

A probe plan runs once for the whole fleet: the columns in ``SCOPE`` travel through every
filter and aggregation, so there is one Spark job for all targets and scrapes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from watchframe.functions.numbers import to_sample_value

SCOPE = ("environment", "target", "ts")
NULL_LABEL = "<nil>"  # fixed value: the label text of a NULL
EVIDENCE_CATEGORIES = ("blocking", "sessions")  # fixed values
DEFAULT_TIMEOUT_MS = 5000  # fixed value

Snapshots = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Metric:
    name: str
    help: str
    value_column: str
    label_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Probe:
    """``rows`` builds the result rows; ``order_column`` breaks ties between rows of one series."""

    name: str
    category: str
    rows: Callable[[Snapshots], DataFrame]
    metrics: tuple[Metric, ...]
    order_column: str | None = None


def _same_text(c: Column, *values: str) -> Column:
    """Equality as the source server does it: case and trailing blanks do not count."""
    return F.lower(F.rtrim(c)).isin(*[v.lower() for v in values])


def _waits(s: Snapshots) -> DataFrame:
    return s["dm_os_wait_stats"].filter("wait_time_ms > 0").select(*SCOPE, "wait_type", "wait_time_ms")


def _blocking(s: Snapshots) -> DataFrame:
    blocked = s["dm_exec_requests"].filter("blocking_session_id <> 0")
    return blocked.groupBy(*SCOPE, "blocking_session_id").agg(F.count("*").alias("blocked_count"))


def _sessions(s: Snapshots) -> DataFrame:
    return s["dm_exec_sessions"].groupBy(*SCOPE, "status").agg(F.count("*").alias("session_count"))


def _memory_pressure(s: Snapshots) -> DataFrame:
    counters = s["dm_os_performance_counters"].filter(_same_text(F.col("counter_name"), "Total Server Memory (KB)"))
    return counters.select(*SCOPE, F.lit("total_server_memory_kb").alias("metric"), "cntr_value")


def _storage(s: Snapshots) -> DataFrame:
    names = s["databases"].select("environment", "target", "database_id", F.col("name").alias("database_name"))
    size_mb = F.col("size") * F.expr("8.0") / F.expr("1024")
    return (
        s["master_files"].join(names, ["environment", "target", "database_id"], "left")
        .select(*SCOPE, "database_name", "file_id", size_mb.alias("size_mb"))
    )


def _throughput(s: Snapshots) -> DataFrame:
    counters = s["dm_os_performance_counters"].filter(
        _same_text(F.col("counter_name"), "Batch Requests/sec", "Transactions/sec"))
    return counters.select(*SCOPE, F.rtrim("counter_name").alias("counter_name"), "cntr_value")


def default_catalog(prefix: str = "sqlserver_") -> dict[str, Probe]:
    """The six built-in probes by name; ``prefix`` starts every metric name."""
    def metric(name: str, text: str, value: str, *labels: str) -> tuple[Metric, ...]:
        return (Metric(prefix + name, text, value, labels),)

    probes = (
        Probe("waits", "waits", _waits, metric("wait_time_ms", "Milliseconds waited so far, for each kind of wait.", "wait_time_ms", "wait_type")),
        Probe("blocking", "blocking", _blocking,
              metric("blocked_requests", "How many requests each session holds up.", "blocked_count", "blocking_session_id")),
        Probe("sessions", "sessions", _sessions, metric("sessions", "Open sessions in each state.", "session_count", "status")),
        Probe("memory_pressure", "memory_pressure", _memory_pressure,
              metric("memory_kb", "Memory the server holds, in KB.", "cntr_value", "metric")),
        Probe("storage", "storage", _storage,
              metric("database_file_size_mb", "Size of each file of a database, in MB.", "size_mb", "database_name"), "file_id"),
        Probe("throughput", "throughput", _throughput,
              metric("throughput", "Running count of batches or transactions.", "cntr_value", "counter_name")),
    )
    return {p.name: p for p in probes}


def register_probe(catalog: Mapping[str, Probe], probe: Probe) -> dict[str, Probe]:
    return {**catalog, probe.name: probe}


def with_template(spark: SparkSession, probe: Probe, template: str | None) -> Probe:
    """The probe with its query replaced by user SQL; a blank template keeps the default.

    Views are written ``sys.<view>``. The SQL must carry the ``SCOPE`` columns through.
    """
    if not template:
        return probe

    def rows(snapshots: Snapshots) -> DataFrame:
        text = template.replace("{", "{{").replace("}", "}}")
        used = {}
        for name in snapshots:
            text, n = re.subn(rf"\bsys\.{name}\b", "{" + name + "}", text)
            if n:
                used[name] = snapshots[name]
        return spark.sql(text, **used)

    return replace(probe, rows=rows, order_column=None)


def run_for_target(probe: Probe, snapshots: Snapshots, environment: str, target: str) -> DataFrame:
    """Rows of one probe for one target; a template without ``SCOPE`` columns gets them as constants."""
    scoped = {
        name: frame.filter((F.col("environment") == environment) & (F.col("target") == target))
        for name, frame in snapshots.items()
    }
    rows = probe.rows(scoped)
    for name, value in (("environment", environment), ("target", target)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows if "ts" in rows.columns else rows.withColumn("ts", F.current_timestamp())


def decode(rows: DataFrame, probe: Probe) -> DataFrame:
    """One sample per row and metric, in one pass.

    A metric whose value column is absent or not numeric gives none; absent label columns are left out.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}

    def label(name: str) -> Column:
        # binary text is read as a string; a NULL becomes a fixed text
        return F.coalesce(F.col(name).cast("string"), F.lit(NULL_LABEL))

    samples = []
    for m in probe.metrics:
        value = to_sample_value(F.col(m.value_column), types[m.value_column]) if m.value_column in types else None
        if value is None:
            continue
        names = ["environment", "target"] + [c for c in m.label_columns if c in types]
        entries = [part for n in names for part in (F.lit(n), label(n))]
        samples.append(F.struct(
            F.lit(m.name).alias("metric"), F.lit(m.help).alias("help"), value.alias("value"),
            F.create_map(*entries).alias("labels"),
        ))
    order = F.col(probe.order_column).cast("long") if probe.order_column else F.lit(0).cast("long")
    kind = "array<struct<metric:string,help:string,value:double,labels:map<string,string>>>"
    exploded = rows.select(
        *SCOPE, order.alias("ord"), F.inline((F.array(*samples) if samples else F.array()).cast(kind)))
    return exploded.filter(F.col("value").isNotNull()).select(*SCOPE, "metric", "help", "ord", "value", "labels")


def binary_to_text(rows: DataFrame) -> DataFrame:
    """Every binary column as text."""
    return rows.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name)
        for f in rows.schema.fields
    ])


def evidence(rows: DataFrame, probe: Probe) -> DataFrame | None:
    """One record per target and scrape with at least one row, for the evidence categories only."""
    if probe.category not in EVIDENCE_CATEGORIES:
        return None
    counted = rows.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    return counted.select(
        *SCOPE,
        F.lit(probe.category).alias("kind"),
        F.concat(F.lit(f"{probe.category} snapshot for "), F.col("target")).alias("title"),
        F.create_map(F.lit("rows"), F.col("n").cast("string")).alias("metadata"),
    )


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def _variants(catalog: Mapping[str, Probe], schedule: DataFrame | None) -> list[tuple[Probe, str]]:
    """Every probe with its own query and with each other query the schedule names for it."""
    variants = [(probe, "") for probe in catalog.values()]
    if schedule is None or "query_template" not in schedule.columns:
        return variants
    # the distinct queries of a schedule are configuration: few, however many targets run them
    named = schedule.select("probe_name", F.trim("query_template").alias("t")).filter("t <> ''").distinct().collect()
    return variants + [
        (with_template(schedule.sparkSession, catalog[r["probe_name"]], r["t"]), r["t"])
        for r in sorted(named, key=lambda r: (r["probe_name"], r["t"])) if r["probe_name"] in catalog]


def collector_cycle(
    snapshots: Snapshots, catalog: Mapping[str, Probe], schedule: DataFrame | None = None, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Samples and evidence of every scheduled probe, as two lazy frames.

    With ``folder``, a shared one, the rows of probes that give both are stored there first, so both come from one run of the probe.

    A target whose schedule carries a ``query_template`` runs that instead of the probe's own query. All probes are decoded
    and united before one join with the schedule.
    """
    samples, proofs = [], []
    for i, (probe, template) in enumerate(_variants(catalog, schedule)):
        rows = binary_to_text(probe.rows(snapshots))
        if folder is not None and probe.category in EVIDENCE_CATEGORIES:
            rows.write.mode("overwrite").parquet(f"{folder}/probe={i}")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/probe={i}")
        mark = {"_probe": F.lit(probe.name), "_template": F.lit(template)}
        samples.append(decode(rows, probe).withColumns(mark))
        proof = evidence(rows, probe)
        if proof is not None:
            proofs.append(proof.withColumns(mark))
    return tuple(_chosen(union(frames), schedule) for frames in (samples, proofs))


def _chosen(rows: DataFrame, schedule: DataFrame | None) -> DataFrame:
    if schedule is not None:
        template = F.coalesce(F.trim("query_template"), F.lit("")) if "query_template" in schedule.columns else F.lit("")
        wanted = schedule.select(
            F.col("environment_slug").alias("environment"), F.col("target_name").alias("target"),
            F.col("probe_name").alias("_probe"), template.alias("_template"))
        rows = rows.join(wanted, ["environment", "target", "_probe", "_template"], "left_semi")
    return rows.select(*[c for c in rows.columns if c not in ("_probe", "_template")])


def unknown_probes(schedule: DataFrame, catalog: Mapping[str, Probe]) -> DataFrame:
    """Scheduled probes that no catalog entry answers."""
    return schedule.filter(~F.col("probe_name").isin(*catalog)).select("collector_id", "target_name", "probe_name")


def effective_timeout_ms(timeout_ms: Column, interval_seconds: Column) -> Column:
    return (
        F.when(timeout_ms > 0, timeout_ms.cast("long"))
        .when(interval_seconds > 0, interval_seconds.cast("long") * 1000)
        .otherwise(F.lit(DEFAULT_TIMEOUT_MS).cast("long"))
    )
