"""Registered queries: every operator over whole tables derived from the given ones.

Times leave as whole epoch numbers and label maps as sorted text, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchframe.functions.labels import label_pairs
from watchframe.functions.text import is_absolute_url
from watchframe.operators import (
    alerts, audit, baselines, contracts, correlate, hash_tree, inventory, investigate, logs, metadata, normalize, probes, reports,
    rolling, rules, series, sketches, sweep,
)
from watchframe.operators.quantiles import exact_quantiles
from watchframe.plans import recipes, replay
from watchframe.plans.fixtures import Fixtures
from watchframe.schemas import Check, ForeignKey, Unique
from watchframe.session import work_dir
from watchframe.sources import sinks
from watchframe.sources.events import read_raw
from watchframe.sources.inventory import read_collectors, read_documents
from watchframe.sources.snapshots import read_metadata, read_snapshots

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
START, END = recipes.GRID_START, recipes.GRID_END
POLICY_NOW = "2024-01-20 00:00:00"
OBSERVED = ("click", "error", "view")
JOBS = "store-api|edge-proxy|store-worker"


def query(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Fixtures(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


def micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or f"{name}_us")


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


# ---- event normalisation and log policy

def _events(f: Fixtures) -> DataFrame:
    return normalize.accepted(normalize.normalize(f.raw_events()))


def accepted_rows(events: DataFrame, labels: Column | None = None) -> DataFrame:
    labels = label_pairs(normalize.text_labels(F.col("labels"))) if labels is None else labels
    return events.select(
        "event_id", micros("timestamp"), "environment", "application", text("component"), text("platform"), "severity",
        "message", text("user_id"), text("session_id"), text("request_id"), text("client_ip"),
        labels.alias("labels"))


@query
def normalize_accepted(f):
    return accepted_rows(_events(f))


@query
def normalize_rejected(f):
    return normalize.rejected(normalize.normalize(f.raw_events()), "event_id")


@query
def event_counts_by_severity(f):
    return normalize.count_accepted(_events(f))


@query
def event_counts_per_hour(f):
    counts = normalize.count_accepted(_events(f), ["environment", "severity"], "1 hour")
    return counts.select(micros("window_start"), "environment", "severity", "n_events")


@query
def labels_scalar_filter(f):
    events = _events(f).filter(F.col("labels").isNotNull())
    return events.select("event_id", label_pairs(normalize.text_labels(F.col("labels"))).alias("labels"))


@query
def event_envelope(f):
    events = _events(f).withColumn("labels", normalize.text_labels(F.col("labels")))
    return events.select("event_id", normalize.envelope_json(events).alias("envelope"))


@query
def alert_deliveries(f):
    return normalize.count_deliveries(normalize.alert_deliveries(f.raw_events()))


@query
def contract_violations(f):
    return contracts.contract_violations(f.raw_events(), "application_event", keep=("event_id",))


def _contract(name: str) -> None:
    def run(f: Fixtures) -> DataFrame:
        return contracts.contract_violations(f.sql(recipes.PAYLOADS[name]), name, keep=("id",))

    run.__name__ = f"contract_{name}"
    query(run)


for _name in recipes.PAYLOADS:
    _contract(_name)


@query
def log_label_policy(f):
    records = logs.log_records(_events(f), "shop-logs", ("telemetry.source", "collector"))
    checked = logs.apply_log_policy(records, max_names=7, max_length=8)
    return checked.select("event_id", "job", "level", label_pairs(F.col("labels")).alias("labels"), text("reject_reason"))


@query
def too_old_rejects(f):
    records = logs.log_records(_events(f), "shop-logs")
    checked = logs.apply_log_policy(records, F.lit(POLICY_NOW).cast("timestamp"))
    return checked.filter("reject_reason is not null").select("event_id", "reject_reason")


# ---- probes and inventory

def sample_rows(samples: DataFrame) -> DataFrame:
    return samples.select("metric", label_pairs(F.col("labels")).alias("labels"), "ord", F.round("value", 6).alias("value"))


def _probe(name: str) -> None:
    def run(f: Fixtures) -> DataFrame:
        probe = probes.default_catalog()[name]
        return sample_rows(probes.decode(probe.rows(f.snapshots()), probe))

    run.__name__ = f"probe_{name}"
    query(run)


for _name in probes.default_catalog():
    _probe(_name)


@query
def probe_cycle_samples(f):
    samples, _ = probes.collector_cycle(f.snapshots(), probes.default_catalog(), _fleet_schedule(f))
    return sample_rows(samples)


@query
def probe_evidence(f):
    _, proofs = probes.collector_cycle(f.snapshots(), probes.default_catalog(), _fleet_schedule(f))
    return proofs.select("environment", "target", "kind", "title", F.col("metadata")["rows"].alias("n_rows"))


def _fleet_schedule(f: Fixtures) -> DataFrame:
    """The six probes on each target, some switched off for one target."""
    return f.sql("""
        SELECT * FROM (SELECT DISTINCT 'fleet' AS collector_id, concat('env', CAST(c_custkey % 3 AS STRING)) AS environment_slug,
               concat('db', CAST(c_custkey % 5 AS STRING)) AS target_name,
               explode(array('waits', 'blocking', 'sessions', 'memory_pressure', 'storage', 'throughput')) AS probe_name
        FROM $customer) s WHERE NOT (target_name = 'db4' AND probe_name IN ('waits', 'storage')) AND NOT (target_name = 'db1' AND probe_name = 'sessions')""")


@query
def probe_schedule_override(f):
    """A cycle in which some targets run a query of their own."""
    sql = "SELECT environment, target, ts, status, count(*) AS session_count FROM sys.dm_exec_sessions WHERE status <> 'building' GROUP BY ALL"
    chosen = F.when((F.col("probe_name") == "sessions") & (F.col("target_name").isin("db0", "db2")), F.lit(sql))
    schedule = _fleet_schedule(f).withColumn("query_template", chosen)
    return sample_rows(probes.collector_cycle(f.snapshots(), probes.default_catalog(), schedule)[0])


@query
def probe_override(f):
    sql = "SELECT environment, target, ts, status, count(*) AS session_count FROM sys.dm_exec_sessions WHERE status <> 'building' GROUP BY ALL"
    probe = probes.with_template(f.spark, probes.default_catalog()["sessions"], sql)
    return sample_rows(probes.decode(probe.rows(f.snapshots()), probe))


@query
def scheduled_probes(f):
    m = {name: f.metadata(name) for name in ("database_targets", "environments", "probe_assignments", "probe_definitions")}
    rows = metadata.scheduled_probes(
        m["database_targets"], m["environments"], m["probe_assignments"], m["probe_definitions"], "sqlserver", "sql-fleet")
    timeout = probes.effective_timeout_ms(F.col("timeout_ms"), F.col("interval_seconds"))
    return rows.withColumn("effective_timeout_ms", timeout)


def _resolved(f: Fixtures) -> DataFrame:
    return inventory.resolve_collectors(f.collectors())


@query
def inventory_flatten(f):
    rows = inventory.inventory_schedule(_resolved(f), "sqlserver")
    timeout = probes.effective_timeout_ms(F.col("timeout_ms"), F.col("interval_seconds"))
    return rows.select("*", timeout.alias("effective_timeout_ms")).drop("engine", "query_template").withColumn(
        "interval_seconds", F.coalesce("interval_seconds", F.lit(-1)))


@query
def inventory_enabled(f):
    on = inventory.enabled_collectors(_resolved(f), "sqlserver")
    return on.select("id", "environment", F.coalesce("interval_s", F.lit(-1.0)).alias("interval_s"), F.size("targets").cast("long").alias("n_targets"))


@query
def inventory_violations(f):
    return inventory.collector_violations(_resolved(f))


@query
def redacted_inventory(f):
    red = inventory.redact_collectors(_resolved(f))
    return red.select("id", F.col("credential_ref").alias("collector_ref"), F.explode("targets").alias("t")).select(
        "id", "collector_ref", F.col("t.name").alias("target_name"), F.col("t.credential_ref").alias("target_ref"))


def _documents(f: Fixtures) -> DataFrame:
    """Inventory documents stored one per line and read back."""
    path = work_dir(f.spark, "documents")
    f.documents().write.text(path)
    return read_documents(f.spark, path)


@query
def document_violations(f):
    return inventory.document_violations(_documents(f), ["document"]).select("document", "entity_kind", "entity", "rule")


@query
def redacted_documents(f):
    """Documents without secret values, with references marked and missing template maps filled."""
    red = inventory.with_template_maps(inventory.redact_document(_documents(f)))
    refs = F.transform("notification_channels", lambda c: F.concat_ws(">", c["id"], c["credential_ref"]))
    return red.select(
        "document", label_pairs(F.col("credential_refs")).alias("secrets"), F.coalesce(F.array_join(refs, "|"), F.lit("")).alias("channels"),
        F.size(F.col("grafana")["dashboard_templates"]).alias("n_boards"), F.size(F.col("loki")["deep_link_templates"]).alias("n_links"))


# ---- series

@query
def series_latest(f):
    last = series.latest(f.samples())
    return last.select("metric", label_pairs(F.col("labels")).alias("labels"), micros("ts"), "value")


@query
def metric_last_value(f):
    asked = f.sql("SELECT DISTINCT concat('app_', event_type) AS metric FROM $events UNION ALL SELECT concat('none_', r_name) FROM $region")
    return series.lookup_last_value(asked, f.samples())


@query
def label_set_violations(f):
    return series.label_set_violations(f.samples())


@query
def metric_help(f):
    return series.metric_help(f.samples())


@query
def panel_last_value(f):
    now = F.timestamp_seconds(F.lit(END))
    last = series.last_not_null(f.samples(), ["metric"], now)
    return last.select("metric", micros("ts"), "value")


# ---- rules and alerts

UP_SERIES = ["job", "instance", "environment"]


def _up(f: Fixtures) -> DataFrame:
    return rules.instant_vector(f.sql(recipes.UP_SAMPLES), UP_SERIES, start=START, end=END, order="event_id")


@query
def up_count(f):
    return rules.count_series(_up(f)).select("step", F.col("value").cast("long").alias("n_series"))


@query
def up_ratio_by_job(f):
    return rules.avg_by(_up(f), ["job"]).select("step", "job", rounded("value"))


@query
def gauge_sum_by(f):
    s = f.samples().select(
        "metric", *[series.label(F.col("labels"), n).alias(n) for n in ("environment", "target", "zone")], "ts", "ord", "value")
    vector = rules.instant_vector(s, ["metric", "environment", "target", "zone"], start=START, end=END, order="ord")
    return rules.sum_by(vector, ["metric", "environment"]).select("step", "metric", "environment", rounded("value", 4))


@query
def rate5m_sum_by(f):
    rates = rules.rate(f.sql(recipes.COUNTER_SAMPLES), ["event_type", "target"], start=START, end=END, order="ord")
    return rules.sum_by(rates, ["event_type"], "rate").select("step", "event_type", rounded("value"))


@query
def rate5m(f):
    rates = rules.rate(f.sql(recipes.COUNTER_SAMPLES), ["event_type", "target"], step_s=60, start=START, end=END, order="ord")
    return rates.select("event_type", "target", "step", "n", rounded("increase"), rounded("rate"))


def _bucketed(f: Fixtures, step_s: int, reach_s: int, chunk_steps: int) -> DataFrame:
    """Counter samples in chunks, stored by series and chunk."""
    keys, root = ["event_type", "target"], work_dir(f.spark, "bucketed")
    chunks = rules.stored_chunks(
        f.sql(recipes.COUNTER_SAMPLES), keys, reach_s=reach_s, step_s=step_s, start=START, end=END, chunk_steps=chunk_steps, order="ord")
    return sinks.store_bucketed(chunks, root.rsplit("/", 1)[1].replace("-", "_"), root, [*keys, "chunk"], 16)


@query
def rate5m_bucketed(f):
    """Rates from samples stored by series and chunk, read without a shuffle."""
    rates = rules.rate_of_chunks(_bucketed(f, 60, 300, 480), ["event_type", "target"], step_s=60)
    return rates.select("event_type", "target", "step", "n", rounded("increase"), rounded("rate"))


def _target_rates(f: Fixtures) -> DataFrame:
    rates = rules.rate(f.sql(recipes.COUNTER_SAMPLES), ["event_type", "target"], start=START, end=END, order="ord")
    return rates.withColumn("environment", F.concat(F.lit("env"), F.col("target") % 3))


@query
def wait_rate_by_target(f):
    """The shipped grouping of wait rates."""
    rates = _target_rates(f).withColumnRenamed("event_type", "wait_type")
    return rules.sum_by(rates, ["environment", "target", "wait_type"], "rate").select("step", "environment", "target", "wait_type", rounded("value"))


@query
def event_rate_by_severity(f):
    """The shipped grouping of event rates."""
    rates = _target_rates(f).select("*", F.concat(F.lit("app"), F.col("target") % 2).alias("application"), F.col("event_type").alias("severity"))
    return rules.sum_by(rates, ["environment", "application", "severity"], "rate").select("step", "environment", "application", "severity", rounded("value"))


def _down(f: Fixtures) -> DataFrame:
    return rules.threshold(_up(f), rules.matches(F.col("job"), JOBS) & (F.col("value") == 0))


@query
def alert_firing(f):
    intervals = alerts.active_intervals(_down(f), UP_SERIES)
    return alerts.alert_states(intervals, UP_SERIES)


def _alert_events(f: Fixtures) -> DataFrame:
    intervals = alerts.active_intervals(_down(f), UP_SERIES)
    return alerts.alert_events(intervals, UP_SERIES, "ServiceDown", "warning", END)


@query
def alert_events(f):
    events = alerts.annotate(_alert_events(f), {"summary": "Service {{ $labels.job }} is down", "place": "{{$labels.environment}}/{{ $labels.instance }}"}, UP_SERIES)
    return events.select("alertname", "severity", *UP_SERIES, "started_s", F.coalesce("resolved_s", F.lit(-1)).alias("resolved_s"), "status", "summary", "place")


@query
def alert_fingerprints(f):
    newest = metadata.newest_per_key(_alert_events(f), ["fingerprint"], ["started_s"])
    return newest.select(*UP_SERIES, "fingerprint", "started_s")


@query
def alert_groups(f):
    groups = alerts.alert_groups(_alert_events(f), ["alertname", "job", "environment"])
    return groups.withColumn("last_resolved_s", F.coalesce("last_resolved_s", F.lit(-1)))


# ---- audits and differences

@query
def snapshot_diff(f):
    return audit.diff(f.table("customer"), f.sql(recipes.CUSTOMER_NEXT), ["c_custkey"]).select("c_custkey", "change")


@query
def snapshot_diff_tree(f):
    """Two stored versions of a table, of which only the leaves that differ are read."""
    root, columns = work_dir(f.spark, "versions"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    hash_tree.store(f.table("customer").select(columns), ["c_custkey"], f"{root}/old")
    hash_tree.store(f.sql(recipes.CUSTOMER_EDITED), ["c_custkey"], f"{root}/new")
    return hash_tree.diff(f.spark, f"{root}/old", f"{root}/new", ["c_custkey"]).select("c_custkey", "change")


@query
def row_version_hash(f):
    return f.table("documents").select("doc_id", audit.content_version(F.col("text")).alias("version"))


@query
def table_version(f):
    return audit.table_version(f.table("customer"))


@query
def audit_unique(f):
    return audit.duplicate_keys(f.table("lineitem"), Unique("lineitem", ("l_orderkey", "l_linenumber")))


@query
def audit_partial_unique(f):
    return audit.duplicate_keys(f.table("lineitem"), Unique("lineitem", ("l_orderkey", "l_linenumber"), "l_linestatus = 'O'"))


def _kept_customers(f: Fixtures) -> DataFrame:
    return f.table("customer").filter("c_custkey % 31 <> 0")


def _gone_customers(f: Fixtures) -> DataFrame:
    return f.table("customer").filter("c_custkey % 31 = 0").select(F.col("c_custkey").alias("id"))


@query
def audit_fk(f):
    return audit.orphan_rows(f.table("orders"), _kept_customers(f), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query
def audit_fk_keys(f):
    return audit.orphan_keys(f.table("orders"), _kept_customers(f), "o_custkey", "c_custkey")


@query
def audit_checks(f):
    orders = audit.broken_checks(f.table("orders"), [Check("orders", "enum:o_orderstatus", "o_orderstatus IN ('F', 'O')")])
    parts = audit.broken_checks(f.table("part"), [Check("part", "range:p_size", "p_size BETWEEN 1 AND 40")])
    return orders.select(F.col("o_orderkey").alias("id"), "rule").unionByName(parts.select(F.col("p_partkey").alias("id"), "rule"))


@query
def audit_temporal(f):
    return audit.broken_checks(f.sql(recipes.WINDOWS), [Check("windows", "temporal", "time_end >= time_start")]).select("id", "rule")


@query
def delete_cascade(f):
    return audit.cascade_removed(f.table("orders"), _gone_customers(f), "o_custkey").select("o_orderkey", "o_custkey")


@query
def delete_set_null(f):
    cleared = audit.set_null(f.table("orders"), _gone_customers(f), "o_custkey")
    return cleared.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


@query
def delete_restrict(f):
    return audit.restrict_blockers(f.table("orders"), _gone_customers(f), "o_custkey")


@query
def metadata_audit(f):
    return audit.audit_tables(f.model())


@query
def delete_effects(f):
    """What removing every other application would do to the tables that refer to it."""
    gone = f.model()["applications"].filter("right(id, 1) IN ('1', '3', '5', '7', '9')").select("id")
    return audit.delete_effects(f.model(), "applications", gone)


CHAIN_KEYS = (
    ForeignKey("purchases", "buyer_id", "buyers", "cascade"), ForeignKey("lines", "purchase_id", "purchases", "cascade"),
    ForeignKey("claims", "line_id", "lines", "restrict"), ForeignKey("notes", "purchase_id", "purchases", "set_null"))


@query
def delete_plan(f):
    """Deletes of buyers, followed through their purchases and lines; a claim on any line blocks the whole delete."""
    tables = {name: f.sql(text) for name, text in recipes.DELETE_CHAIN.items()}
    gone = tables["buyers"].filter("right(id, 1) IN ('1', '3', '6')")
    return audit.delete_plan(tables, "buyers", gone, work_dir(f.spark, "delete"), CHAIN_KEYS)


# ---- investigations and links

@query
def investigation_overlap(f):
    found = correlate.overlapping_investigations(f.metadata("requests"), f.metadata("investigations"), f.metadata("slugs"))
    return found.select("request_id", "investigation_id", "environment_slug", "subject_type", "subject_value")


def _correlated(f: Fixtures, find: Callable[..., DataFrame] = correlate.correlate_subjects, **how) -> DataFrame:
    windows = correlate.subject_windows(f.sql(recipes.CORRELATION_WINDOWS))
    return find(f.sql(recipes.CORRELATION_EVENTS), windows, ["event_id", "timestamp", "component", "severity"], **how)


@query
def subject_correlation(f):
    return _correlated(f).select("investigation_id", "event_id")


@query
def latest_n_per_env(f):
    return metadata.newest_investigations(f.metadata("investigations"), n=5).select("environment_id", "id", micros("created_at"))


@query
def failed_runs_per_app(f):
    return metadata.report_runs_by_status(f.metadata("report_runs"), "failed", 3).select("application_id", "id", micros("created_at"))


@query
def application_links(f):
    environments = f.metadata("environments")
    applications = f.sql("SELECT s_suppkey AS id, s_nationkey AS environment_id, s_name AS name FROM $supplier")
    users = f.sql("SELECT c_custkey AS id, concat(lower(c_name), '@example.com') AS email FROM $customer")
    requests = f.sql("""
        SELECT o_orderkey AS request_id, s_name AS application_name, lower(n_name) AS environment_slug, concat(lower(c_name), '@example.com') AS user_email
        FROM $orders JOIN $customer ON o_custkey = c_custkey JOIN $supplier ON s_suppkey = o_orderkey % (SELECT max(s_suppkey) + 1 FROM $supplier) JOIN $nation ON n_nationkey = s_nationkey""")
    linked = metadata.link_applications(applications, environments, users, requests)
    return linked.select("request_id", "application_id", "environment_id", "user_id")


@query
def deep_links(f):
    templates = f.spark.createDataFrame(list(recipes.LINK_TEMPLATES.items()), "template_name string, template string")
    records = f.sql("""
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'logs' ELSE 'target' END AS template_name,
               concat('{app="shop", user="', CAST(user_id AS STRING), '"} |= `', event_type, ' & more`') AS query,
               concat('db ', CAST(user_id % 5 AS STRING), '/é') AS target FROM $events""")
    return correlate.deep_links(records, templates, {"query": F.col("query"), "target": F.col("target")}).select("event_id", "url")


# ---- tables written and read back

@query
def sink_samples(f):
    path = work_dir(f.spark, "samples")
    sinks.append_samples(f.samples(), path)
    stored = f.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"), "metric")
    return stored.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def sink_logs(f):
    path = work_dir(f.spark, "logs")
    sinks.append_logs(logs.log_records(_events(f), "shop-logs"), path)
    stored = f.spark.read.parquet(path)
    return stored.groupBy("job", "level", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query
def publish_guard(f):
    """A sound version is published, once more with equal content, then from what is current; a broken one is refused."""
    return sinks.read_current(f.spark, _published(f)).select("c_custkey", rounded("c_acctbal", 2))


@query
def publish_log(f):
    log = sinks.read_log(f.spark, _published(f))
    return log.groupBy("accepted", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("version").alias("n_versions"))


def _published(f: Fixtures) -> str:
    root = work_dir(f.spark, "publish")

    def rules_of(df: DataFrame) -> DataFrame:
        return audit.duplicate_keys(df, Unique("customer", ("c_custkey",)))

    good = f.table("customer").select("c_custkey", "c_acctbal")
    sinks.publish(good, rules_of, root)
    sinks.publish(good, rules_of, root)
    sinks.publish(sinks.read_current(f.spark, root), rules_of, root)
    sinks.publish(good.unionByName(good.filter("c_custkey % 9 = 0")), rules_of, root)
    return root


# ---- planned tier: baselines, investigation results, reports

@query
def baseline_mad(f):
    band = baselines.mad_band(f.table("events"), ["event_type"], "value")
    return band.select("event_type", "n", *[rounded(c) for c in ("median", "mad", "lower", "upper")])


@query
def rolling_mad(f):
    """Bands over the seven days that end with each day."""
    band = rolling.rolling_mad(f.table("events"), ["event_type"], "value", 86_400, 7, work_dir(f.spark, "rolling"), chunk_width=10)
    return band.select("event_type", "bucket", "n", *[rounded(c) for c in ("median", "mad", "lower", "upper")])


@query
def baseline_quantile(f):
    band = baselines.quantile_band(f.table("events"), ["event_type"], "value")
    return band.select("event_type", "n", rounded("lower"), rounded("upper"))


@query
def baseline_stored(f):
    """Baselines written in the shape of the stored table and read back with typed parameters."""
    path = work_dir(f.spark, "baselines")
    band = baselines.quantile_band(f.table("events"), ["event_type"], "value").select("event_type", "n", rounded("lower"), rounded("upper"))
    rows = baselines.baseline_rows(band, F.lit("shop"), F.col("event_type"), "30d", "quantile", ["n", "lower", "upper"], F.timestamp_seconds(F.lit(END)))
    rows.write.parquet(path)
    read = baselines.stored_parameters(f.spark.read.parquet(path), {"n": "bigint", "lower": "double", "upper": "double"})
    return read.select("application_id", "signal_key", "window", "method", "n", "lower", "upper", micros("last_computed_at"))


@query
def read_metadata_tables(f):
    """Metadata tables stored and read with their schema."""
    root = work_dir(f.spark, "metadata")
    for name in ("users", "applications"):
        f.model()[name].write.parquet(f"{root}/{name}")
    t = read_metadata(f.spark, root, ("users", "applications"))
    users = t["users"].groupBy(F.lit("users").alias("table"), text("status")).agg(F.count("id").alias("n"), F.countDistinct("email").alias("n_names"))
    applications = t["applications"].groupBy(F.lit("applications").alias("table"), text("status")).agg(F.count("id").alias("n"), F.countDistinct("name").alias("n_names"))
    return users.unionByName(applications)


@query
def binary_labels(f):
    """Label columns that arrive as bytes."""
    rows = f.table("customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("c_name"), F.encode(F.concat("c_mktsegment", F.lit(" é")), "UTF-8").alias("segment"))
    return probes.binary_to_text(rows)


@query
def absolute_urls(f):
    """Which page addresses name a scheme and a host, some of them cut short."""
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^[a-z]+:", "")).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "//[^/]*", "//")).when(
        F.col("page_id") % 5 == 2, F.lit("")).otherwise(F.col("url"))
    return f.table("pages").select("page_id", is_absolute_url(url).alias("absolute"))


@query
def special_quantiles(f):
    """Quantiles over values with infinities and NaN, which is the largest."""
    found = exact_quantiles(f.sql(recipes.SPECIAL_VALUES), ["event_type"], "value", {"low": 0.0, "middle": 0.5, "high": 0.9, "top": 1.0})
    return found.select("event_type", "n", *[F.col(c).cast("string").alias(c) if c != "middle" else rounded(c) for c in ("low", "middle", "high", "top")])


@query
def null_key_breaches(f):
    """Breaches where the key of some rows is NULL: they have a band of their own."""
    events = f.table("events").withColumn("kind", F.when(F.col("event_type") != "click", F.col("event_type")))
    band = baselines.quantile_band(events, ["kind"], "value")
    return baselines.hybrid_breaches(events, band, ["kind"], "value", 200.0).select("event_id", text("kind"), "cause")


@query
def newest_alerts(f):
    newest = metadata.newest_alert(f.model()["alert_events"])
    return newest.select("application_id", "fingerprint", "id", micros("started_at"))


@query
def scheduled_probes_of_targets(f):
    """The schedule limited to one environment and two targets."""
    m = {name: f.metadata(name) for name in ("database_targets", "environments", "probe_assignments", "probe_definitions")}
    names = [r["s_name"] for r in f.sql("SELECT min(s_name) AS s_name FROM $supplier WHERE s_nationkey = 3 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0").collect()]
    return metadata.scheduled_probes(
        m["database_targets"], m["environments"], m["probe_assignments"], m["probe_definitions"], "sqlserver", "sql-fleet", "nation_3", [*names, "none"])


@query
def snapshot_diff_live(f):
    """A row that is switched off counts as removed."""
    old = f.table("customer").withColumn("enabled", F.col("c_custkey") % 6 != 0)
    new = f.sql(recipes.CUSTOMER_NEXT).withColumn("enabled", F.col("c_custkey") % 4 != 0)
    return audit.diff(old, new, ["c_custkey"], F.col("enabled")).select("c_custkey", "change")


@query
def read_raw_events(f):
    """Raw documents written as text, one per line, and read back."""
    path = work_dir(f.spark, "raw")
    f.raw_events().select("value").write.text(path)
    return read_raw(f.spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query
def sink_evidence(f):
    path = work_dir(f.spark, "evidence")
    sinks.append_evidence(probes.collector_cycle(f.snapshots(), probes.default_catalog(), _fleet_schedule(f))[1], path)
    stored = f.spark.read.parquet(path)
    return stored.select("environment", "target", "kind", "title", F.col("metadata")["rows"].alias("n_rows"))


@query
def sink_report(f):
    """A report section written as CSV and as JSON and read back."""
    root = work_dir(f.spark, "report")
    health = reports.health_summary(f.sql(recipes.SUBJECT_EVENTS), ["application"], F.col("severity") == "error").select("application", "n_events", "n_errors")
    sinks.write_report(health, f"{root}/csv", "csv")
    sinks.write_report(health, f"{root}/json")
    kinds = "application string, n_events bigint, n_errors bigint"
    return f.spark.read.schema(kinds).option("header", True).csv(f"{root}/csv").unionByName(f.spark.read.schema(kinds).json(f"{root}/json"))


@query
def read_snapshot_tables(f):
    """Snapshot tables stored, read back and probed."""
    root = work_dir(f.spark, "snapshots")
    for name, frame in f.snapshots().items():
        frame.write.parquet(f"{root}/{name}")
    probe = probes.default_catalog()["blocking"]
    return sample_rows(probes.decode(probe.rows(read_snapshots(f.spark, root)), probe))


@query
def read_collector_table(f):
    path = work_dir(f.spark, "collectors")
    f.collectors().write.parquet(path)
    on = inventory.enabled_collectors(inventory.resolve_collectors(read_collectors(f.spark, path)), "sqlserver")
    return on.select("id", "environment", F.coalesce("interval_s", F.lit(-1.0)).alias("interval_s"), F.size("targets").cast("long").alias("n_targets"))


@query
def observed_counts(f):
    """Accepted events by severity, counted by the job that writes them."""
    counts = sinks.store_events(_events(f).drop("labels"), work_dir(f.spark, "observed"), OBSERVED)
    return f.spark.createDataFrame(list(counts.items()), "severity string, n_events bigint")


@query
def sketch_bands(f):
    """Bands of trailing weeks from daily sketches; do their ranks, counted exactly, lie within twice the stated error?"""
    keys, probs = ["event_type"], {"lower": 0.05, "upper": 0.95}
    events = f.table("events")
    weeks = sketches.trailing(sketches.bucket_sketches(events, keys, "value", 86_400), keys, 86_400, 7)
    bands = sketches.sketch_quantiles(weeks, probs)
    day = F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(86_400))
    spans = events.select(*keys, "value", F.explode(F.sequence(day, day + 6 * 86_400, F.lit(86_400).cast("long"))).alias("bucket"))
    counts = [F.count_if(F.col("value") < F.col(name)).alias(f"below_{name}") for name in probs]
    counts += [F.count_if(F.col("value") <= F.col(name)).alias(f"upto_{name}") for name in probs]
    ranked = spans.join(bands, [*keys, "bucket"]).groupBy(*keys, "bucket", "n").agg(*counts)
    slack = F.col("n") * (2 * sketches.RANK_ERROR) + 1
    near = [(F.col(f"below_{name}") <= F.col("n") * p + slack) & (F.col(f"upto_{name}") >= F.col("n") * p - slack) for name, p in probs.items()]
    return ranked.select(*keys, "bucket", "n", (near[0] & near[1]).alias("near"))


@query
def baseline_ewma(f):
    means = baselines.bucket_means(f.table("events"), ["event_type"], "value", 3600)
    return baselines.ewma_deviation(means, ["event_type"]).select(
        "event_type", "bucket", *[rounded(c) for c in ("mean", "ewma", "deviation")])


@query
def baseline_seasonal(f):
    base = baselines.seasonal_baseline(f.table("events"), ["event_type"], "value")
    return base.select("event_type", F.col("dow").cast("long").alias("dow"), F.col("hour").cast("long").alias("hour"), "n", rounded("mean"), rounded("deviation"))


@query
def anomalies(f):
    events = f.table("events")
    band = baselines.quantile_band(events, ["event_type"], "value")
    return baselines.hybrid_breaches(events, band, ["event_type"], "value", 200.0).select("event_id", "event_type", "cause")


@query
def alert_cooldown(f):
    kept = baselines.apply_cooldown(_alert_events(f), ["job"], 1800)
    return kept.groupBy("job", "started_s").agg(F.count("*").alias("n"))


@query
def correlated_alerts(f):
    return sweep.correlated_signals(_alert_events(f), ["environment"], 900, "job")


@query
def correlated_events(f):
    """Users with events of several kinds within a minute, whatever border of time lies between them."""
    events = f.table("events").select("user_id", "event_type", F.unix_seconds("ts").alias("started_s"))
    return sweep.correlated_signals(events, ["user_id"], 3600, "event_type", 3, chunk_s=7200)


@query
def sessions(f):
    return investigate.sessions(f.table("events"), ["user_id"])


@query
def investigation_timeline(f):
    packed = _correlated(f, correlate.correlate_in_order)
    return investigate.timeline(packed).select("investigation_id", "event_id", micros("timestamp"), "component", "severity")


@query
def due_runs(f):
    schedules = f.sql("""SELECT concat('rs', CAST(s_suppkey AS STRING)) AS id, concat('app', CAST(s_nationkey AS STRING)) AS application_id,
        'weekly' AS report_template_id, s_suppkey % 4 <> 0 AS enabled FROM $supplier""")
    due = f.sql("SELECT concat('rs', CAST(l_suppkey AS STRING)) AS schedule_id, l_shipdate AS time_start, l_shipdate + INTERVAL '7' DAY AS time_end FROM $lineitem")
    return reports.due_runs(schedules, due).groupBy("schedule_id", "application_id", "status").agg(F.count("*").alias("n"))


@query
def investigation_summary(f):
    found = investigate.summary(_correlated(f, count_by=["component", "severity"]))
    return found.select("investigation_id", "component", "severity", "n_events", micros("first_seen"), micros("last_seen"))


@query
def investigation_severity(f):
    rated = investigate.result_severity(_correlated(f, count_by=["severity"]), F.col("severity") == "error", 0.3, 0.6)
    return rated.select("investigation_id", "n_events", rounded("error_share"), "severity")


@query
def anomaly_windows(f):
    events = f.sql(recipes.SUBJECT_EVENTS)
    return investigate.anomaly_windows(events, ["application"], F.col("severity") == "error", 3600, 2)


@query
def error_fingerprint(f):
    return investigate.error_groups(f.table("documents"), ["source"], "text")


@query
def latency_quantiles(f):
    duration = F.get_json_object("props", "$.k")
    latency = investigate.latency_by(f.table("events"), ["event_type"], duration)
    return latency.select("event_type", "n", rounded("p50"), rounded("p95"))


def _deltas(f: Fixtures) -> DataFrame:
    at = [F.lit(d).cast("timestamp") for d in ("2024-01-16", "2024-01-01", "2024-01-31")]
    errors = F.when(F.col("severity") == "error", 1).otherwise(0).cast("long")
    return reports.period_delta(
        f.sql(recipes.SUBJECT_EVENTS), ["application", "component"], "timestamp", *at,
        {"events": F.lit(1).cast("long"), "errors": errors})


@query
def period_delta(f):
    return _deltas(f)


@query
def top_regressions(f):
    ranked = reports.top_regressions(_deltas(f), ["application"], "errors_delta", ["component"], 3)
    return ranked.select("application", "component", "errors_delta", F.col("rank").cast("long").alias("rank"))


@query
def wait_hotspots(f):
    probe = probes.default_catalog()["waits"]
    samples = probes.decode(probe.rows(f.snapshots()), probe)
    flat = samples.select(*[F.col("labels")[n].alias(n) for n in ("environment", "target", "wait_type")], "value")
    top = reports.top_n(flat, ["environment"], "value", ["target", "wait_type"], 2)
    return top.select("environment", "target", "wait_type", "value", F.col("rank").cast("long").alias("rank"))


@query
def alert_noise(f):
    noise = reports.alert_noise(_alert_events(f), ["job", "environment"])
    return noise.withColumn("firing_s", F.coalesce("firing_s", F.lit(0)))


@query
def slo_delta(f):
    return reports.slo_delta(_up(f), ["job"], 0.95).select("job", rounded("ratio"), "n_steps", rounded("delta"))


@query
def report_payload(f):
    health = reports.health_summary(f.sql(recipes.SUBJECT_EVENTS), ["application"], F.col("severity") == "error")
    health = health.withColumn("error_ratio", F.round("error_ratio", 6))
    worst = reports.top_regressions(_deltas(f), ["application"], "errors_delta", ["component"], 3)
    sections = [
        reports.section(health, F.col("application"), "health", "Health summary", ["n_events", "n_errors", "error_ratio"]),
        reports.section(worst, F.col("application"), "regressions", "Top regressions", ["rank", "component", "errors_delta"], [F.col("rank")], 3),
    ]
    return reports.report_payload(sections, "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")


@query
def collector_health(f):
    health = reports.collector_health(f.sql(recipes.PROBE_RUNS), ["collector_id"], F.lit("2030-01-01").cast("timestamp"))
    return health.select("collector_id", "n_runs", "n_failed", "age_s", rounded("p50_ms"), rounded("p95_ms"))


# ---- streaming twins: a whole run over the files, then the stored result

@query
def stream_normalize(f):
    return accepted_rows(replay.normalized(f)[0], label_pairs(F.col("labels")))


@query
def stream_rejected(f):
    return replay.normalized(f)[1].select("event_id", "reject_reason")


@query
def stream_latest(f):
    return replay.latest(f).select("metric", label_pairs(F.col("labels")).alias("labels"), micros("ts"), "value")


@query
def stream_counts(f):
    return replay.counts(f).select(micros("window_start"), "environment", "severity", "n_events")


@query
def stream_alert_hold(f):
    truth = rules.matches(F.col("job"), JOBS) & (F.col("value") == 0)
    evaluations = _up(f).select(*UP_SERIES, "step", F.timestamp_seconds("step").alias("at"), truth.alias("is_true"))
    held = replay.alert_hold(f, evaluations, UP_SERIES)
    return held.filter(f"kind = 'firing' OR at_s <= {END}").select(*UP_SERIES, "kind", "started_s", "at_s")


@query
def stream_alert_dedup(f):
    return replay.alert_dedup(f).select("fingerprint", micros("started_at", "started_us"))


@query
def stream_probe_cycle(f):
    return sample_rows(replay.poll(f, _fleet_schedule(f)))


@query
def stream_observed_counts(f):
    """Counts by severity, kept by the write of each batch."""
    return replay.observed(f, OBSERVED).groupBy("severity").agg(F.sum("n_events").alias("n_events"))


@query
def stream_sessions(f):
    return replay.sessions(f, ["user_id"])
