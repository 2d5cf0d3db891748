"""Collector inventory: inheritance, flattening to scheduled probes, validation and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.functions.text import blank_to_null, first_non_empty, is_absolute_url, is_secret_ref, redact_ref, trim_space
from watchframe.functions.timeparse import duration_seconds
from watchframe.operators.probes import union

DEFAULT_INTERVAL_S = 30.0  # fixed value
# Endpoint URLs and whether they must be set.
ENDPOINT_URLS = (
    ("grafana", "base_url", True), ("loki", "base_url", True), ("alertmanager", "base_url", True),
    ("opentelemetry", "endpoint", False),
)


def _text(c: Column) -> Column:
    return trim_space(F.coalesce(c, F.lit("")))


def _probes(c: Column) -> Column:
    """Probes with trimmed names; nameless ones are dropped."""
    tidy = F.transform(c, lambda p: F.struct(
        _text(p["name"]).alias("name"),
        F.coalesce(p["query_template"], F.lit("")).alias("query_template"),
        F.coalesce(p["timeout_ms"], F.lit(0)).alias("timeout_ms")))
    kept = F.filter(tidy, lambda p: p["name"] != "")
    return F.coalesce(kept, F.expr("cast(array() as array<struct<name:string,query_template:string,timeout_ms:int>>)"))


def collectors_of(document: DataFrame) -> DataFrame:
    """Collector rows of whole inventory documents."""
    return document.select(F.inline("collectors"))


def resolve_collectors(collectors: DataFrame) -> DataFrame:
    """Collectors with trimmed texts, defaults and inherited target settings.

    A target without environment, credential or probes takes those of its collector. ``interval_s``
    is NULL when the interval text is malformed.
    """
    cfg = F.col("config")
    interval = cfg["scrape_interval"]
    own = collectors.select(
        _text(F.col("id")).alias("id"), _text(F.col("kind")).alias("kind"),
        F.coalesce("enabled", F.lit(False)).alias("enabled"), _text(F.col("credential_ref")).alias("credential_ref"),
        _text(cfg["environment"]).alias("environment"),
        F.coalesce(cfg["target_names"], F.expr("cast(array() as array<string>)")).alias("target_names"),
        F.when(F.coalesce(interval, F.lit("")) == "", F.lit(DEFAULT_INTERVAL_S)).otherwise(duration_seconds(interval)).alias("interval_s"),
        _probes(cfg["probes"]).alias("probes"), cfg["targets"].alias("raw_targets"))

    def target(t: Column) -> Column:
        probes = _probes(t["probes"])
        return F.struct(
            _text(t["name"]).alias("name"),
            first_non_empty(_text(t["environment"]), F.col("environment")).alias("environment_slug"),
            F.col("kind").alias("engine"), _text(t["host"]).alias("host"),
            F.coalesce(t["port"], F.lit(0)).alias("port"), _text(t["database_name"]).alias("database_name"),
            first_non_empty(_text(t["credential_ref"]), F.col("credential_ref")).alias("credential_ref"),
            F.when(F.size(probes) == 0, F.col("probes")).otherwise(probes).alias("probes"))

    resolved = F.coalesce(F.transform("raw_targets", target), F.expr("array()"))
    return own.withColumn("targets", resolved).drop("raw_targets")


def enabled_collectors(resolved: DataFrame, kind: str) -> DataFrame:
    return resolved.filter(F.col("enabled") & (F.col("kind") == kind)).orderBy("id")


def inventory_schedule(resolved: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per enabled collector, selected target and probe."""
    on = resolved.filter("enabled")
    if kind is not None:
        on = on.filter(F.col("kind") == kind)
    per_target = on.select(
        F.col("id").alias("collector_id"), "target_names", F.floor("interval_s").cast("int").alias("interval_seconds"),
        F.explode("targets").alias("t")
    ).filter((F.size("target_names") == 0) | F.array_contains("target_names", F.col("t.name")))
    return per_target.select(
        "collector_id", "t.environment_slug", F.col("t.name").alias("target_name"), "t.engine", "t.host", "t.port",
        "t.database_name", "t.credential_ref", "interval_seconds", F.explode("t.probes").alias("p")
    ).select(
        "collector_id", "environment_slug", "target_name", "engine", "host", "port", "database_name", "credential_ref",
        F.col("p.name").alias("probe_name"), "p.query_template", "p.timeout_ms", "interval_seconds")


def _failed(*rules: tuple[str, Column]) -> Column:
    """Array of the names of the rules that hold (a rule describes a fault)."""
    marks = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]
    return F.filter(F.array(*marks), lambda r: r.isNotNull())


def _report(rows: DataFrame, kind: str, collector: Column, entity: Column, rules: Column, keys: Sequence[str] = ()) -> DataFrame:
    return rows.select(
        *keys, F.lit(kind).alias("entity_kind"), collector.alias("collector_id"), entity.alias("entity"),
        F.explode(rules).alias("rule"))


def _bad_ref(c: Column) -> Column:
    return (c != "") & ~is_secret_ref(c)


def collector_violations(resolved: DataFrame) -> DataFrame:
    """Every broken inventory rule: ``entity_kind``, ``collector_id``, ``entity``, ``rule``."""
    collector_rules = _failed(
        ("id_missing", F.col("id") == ""), ("kind_missing", F.col("kind") == ""),
        ("interval_unreadable", F.col("interval_s").isNull()),
        ("interval_not_positive", F.col("interval_s") <= 0),
        ("credential_not_a_reference", _bad_ref(F.col("credential_ref"))))
    broken_collectors = _report(resolved, "collector", F.col("id"), F.col("id"), collector_rules)
    repeated = resolved.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("id") != ""))
    repeated_ids = _report(repeated, "collector", F.col("id"), F.col("id"), F.array(F.lit("id_repeated")))
    targets = resolved.select(F.col("id").alias("collector_id"), F.explode("targets").alias("t")).select("collector_id", "t.*")
    target_rules = _failed(
        ("name_missing", F.col("name") == ""), ("host_missing", F.col("host") == ""),
        ("port_range", ~F.col("port").between(1, 65535)),
        ("credential_not_a_reference", _bad_ref(F.col("credential_ref"))),
        ("timeout_negative", F.exists("probes", lambda p: p["timeout_ms"] < 0)))
    broken_targets = _report(targets, "target", F.col("collector_id"), F.col("name"), target_rules)
    named = targets.filter("name <> ''").groupBy("collector_id", "name").agg(F.count("*").alias("n")).filter("n > 1")
    repeated_targets = _report(named, "target", F.col("collector_id"), F.col("name"), F.array(F.lit("name_repeated")))
    known = F.transform("targets", lambda t: t["name"])
    unknown = resolved.filter(F.size("targets") > 0).select(
        "id", F.explode(F.array_except("target_names", known)).alias("name"))
    unknown_names = _report(unknown, "target_names", F.col("id"), F.col("name"), F.array(F.lit("name_unknown")))
    return union([broken_collectors, repeated_ids, broken_targets, repeated_targets, unknown_names])


def document_violations(document: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Broken endpoint and notification-channel rules of inventory documents.

    ``keys`` name the columns that tell documents apart; they come first in the result, and a channel id may recur under another
    key. Without keys all rows are parts of one inventory.
    """
    none = F.lit("")
    checks = []
    for name, field, required in ENDPOINT_URLS:
        url = F.coalesce(F.col(name)[field], F.lit(""))
        if required:
            checks.append((f"url_missing:{name}", url == ""))
        checks.append((f"url_not_absolute:{name}", (url != "") & ~is_absolute_url(url)))
    endpoints = _report(document, "endpoint", none, none, _failed(*checks), keys)
    raw = document.select(*keys, F.explode("notification_channels").alias("_channel"))
    channels = raw.select(*keys, *[
        F.coalesce(F.col("_channel")[c], F.lit("")).alias(f"_{c}") for c in ("id", "channel_type", "target_ref", "credential_ref")])
    rules = _failed(
        ("id_missing", F.col("_id") == ""),
        ("channel_incomplete", (F.col("_channel_type") == "") | (F.col("_target_ref") == "")),
        ("credential_not_a_reference", _bad_ref(F.col("_credential_ref"))))
    broken = _report(channels, "channel", none, F.col("_id"), rules, keys)
    twice = channels.filter("_id <> ''").groupBy(*keys, "_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = _report(twice, "channel", none, F.col("_id"), F.array(F.lit("id_repeated")), keys)
    return union([endpoints, broken, repeated])


def redact_collectors(resolved: DataFrame) -> DataFrame:
    """Collectors with every secret reference marked; the input frame is left as it is."""
    targets = F.transform("targets", lambda t: t.withField("credential_ref", redact_ref(t["credential_ref"])))
    return resolved.withColumn("credential_ref", redact_ref(F.col("credential_ref"))).withColumn("targets", targets)


def redact_document(document: DataFrame) -> DataFrame:
    """Documents with secret values masked and channel references marked."""
    channels = F.transform("notification_channels", lambda c: c.withField(
        "credential_ref", redact_ref(F.coalesce(c["credential_ref"], F.lit("")))))
    masked = F.transform_values("credential_refs", lambda _, v: F.lit("<redacted>"))
    return document.withColumn("notification_channels", channels).withColumn("credential_refs", masked)


def with_template_maps(document: DataFrame) -> DataFrame:
    """Endpoints with missing template maps replaced by empty ones."""
    empty = F.expr("cast(map() as map<string,string>)")
    for name, _, _ in ENDPOINT_URLS:
        filled = F.col(name)
        for field in ("dashboard_templates", "deep_link_templates"):
            filled = filled.withField(field, F.coalesce(F.col(name)[field], empty))
        document = document.withColumn(name, F.when(F.col(name).isNotNull(), filled))
    return document


def probe_override(template: Column, default: Column) -> Column:
    """The configured query, or the default one when none is configured."""
    return F.coalesce(blank_to_null(template), default)
