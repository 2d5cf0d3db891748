"""Schemas of samples, evidence, inventory and the metadata tables, with their constraints."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLE = "metric STRING, help STRING, ts TIMESTAMP, ord BIGINT, value DOUBLE, labels MAP<STRING,STRING>"
EVIDENCE = "environment STRING, target STRING, ts TIMESTAMP, kind STRING, title STRING, metadata MAP<STRING,STRING>"

PROBES = "ARRAY<STRUCT<name: STRING, query_template: STRING, timeout_ms: INT>>"
TARGETS = (
    "ARRAY<STRUCT<name: STRING, environment: STRING, host: STRING, port: INT, database_name: STRING, "
    f"credential_ref: STRING, probes: {PROBES}>>"
)
COLLECTORS = (
    "id STRING, kind STRING, enabled BOOLEAN, credential_ref STRING, "
    f"config STRUCT<environment: STRING, scrape_interval: STRING, target_names: ARRAY<STRING>, targets: {TARGETS}, probes: {PROBES}>"
)
ENDPOINT = (
    "STRUCT<base_url: STRING, endpoint: STRING, dashboard_templates: MAP<STRING,STRING>, "
    "deep_link_templates: MAP<STRING,STRING>>"
)
INVENTORY = (
    f"grafana {ENDPOINT}, loki {ENDPOINT}, alertmanager {ENDPOINT}, opentelemetry {ENDPOINT}, "
    "notification_channels ARRAY<STRUCT<id: STRING, channel_type: STRING, target_ref: STRING, credential_ref: STRING, "
    "config: MAP<STRING,STRING>>>, credential_refs MAP<STRING,STRING>, "
    "collectors ARRAY<STRUCT<id: STRING, kind: STRING, enabled: BOOLEAN, credential_ref: STRING, "
    "config: STRUCT<environment: STRING, scrape_interval: STRING, target_names: ARRAY<STRING>, "
    f"targets: {TARGETS}, probes: {PROBES}>>>"
)

_AUDIT = "created_at TIMESTAMP, updated_at TIMESTAMP"

# Columns of the 22 metadata tables. JSON columns are JSON text.
METADATA_TABLES: dict[str, str] = {
    "users": f"id STRING, email STRING, display_name STRING, status STRING, last_login_at TIMESTAMP, {_AUDIT}",
    "roles": f"id STRING, name STRING, description STRING, {_AUDIT}",
    "user_roles": "user_id STRING, role_id STRING, created_at TIMESTAMP",
    "environments": f"id STRING, name STRING, slug STRING, type STRING, description STRING, status STRING, labels STRING, {_AUDIT}",
    "applications": f"id STRING, environment_id STRING, name STRING, platform STRING, owner_team STRING, criticality STRING, status STRING, {_AUDIT}",
    "application_components": f"id STRING, application_id STRING, name STRING, component_type STRING, runtime_name STRING, labels STRING, {_AUDIT}",
    "telemetry_sources": f"id STRING, application_id STRING, source_type STRING, ingest_mode STRING, status STRING, config STRING, {_AUDIT}",
    "normalization_rules": f"id STRING, source_type STRING, version STRING, enabled BOOLEAN, rule_config STRING, created_by STRING, {_AUDIT}",
    "database_targets": f"id STRING, environment_id STRING, engine STRING, name STRING, host STRING, port INT, database_name STRING, status STRING, credential_ref STRING, labels STRING, {_AUDIT}",
    "probe_definitions": f"id STRING, engine STRING, name STRING, version STRING, category STRING, default_interval_seconds INT, timeout_ms INT, query_template STRING, enabled BOOLEAN, {_AUDIT}",
    "probe_assignments": f"id STRING, database_target_id STRING, probe_definition_id STRING, interval_seconds INT, enabled BOOLEAN, config STRING, {_AUDIT}",
    "investigations": f"id STRING, application_id STRING, environment_id STRING, created_by STRING, status STRING, subject_type STRING, subject_value STRING, time_start TIMESTAMP, time_end TIMESTAMP, query STRING, {_AUDIT}",
    "investigation_jobs": f"id STRING, investigation_id STRING, status STRING, queued_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, error_message STRING, {_AUDIT}",
    "investigation_results": "id STRING, investigation_id STRING, summary STRING, severity STRING, result STRING, created_at TIMESTAMP",
    "evidence_links": "id STRING, investigation_id STRING, source_type STRING, title STRING, url STRING, time_start TIMESTAMP, time_end TIMESTAMP, metadata STRING, created_at TIMESTAMP",
    "alert_policies": f"id STRING, application_id STRING, name STRING, signal_type STRING, severity STRING, enabled BOOLEAN, condition STRING, labels STRING, rendered_rule_ref STRING, {_AUDIT}",
    "adaptive_baselines": f"id STRING, application_id STRING, signal_key STRING, window STRING, method STRING, parameters STRING, last_computed_at TIMESTAMP, {_AUDIT}",
    "notification_routes": f"id STRING, application_id STRING, name STRING, channel_type STRING, target_ref STRING, routing_rules STRING, enabled BOOLEAN, alertmanager_route_ref STRING, {_AUDIT}",
    "alert_events": f"id STRING, application_id STRING, alert_policy_id STRING, status STRING, severity STRING, fingerprint STRING, started_at TIMESTAMP, resolved_at TIMESTAMP, labels STRING, {_AUDIT}",
    "report_templates": f"id STRING, name STRING, description STRING, template_type STRING, template_config STRING, enabled BOOLEAN, {_AUDIT}",
    "report_schedules": f"id STRING, application_id STRING, report_template_id STRING, cron_expression STRING, timezone STRING, recipients STRING, enabled BOOLEAN, {_AUDIT}",
    "report_runs": f"id STRING, application_id STRING, report_schedule_id STRING, requested_by STRING, status STRING, time_start TIMESTAMP, time_end TIMESTAMP, artifact_uri STRING, started_at TIMESTAMP, finished_at TIMESTAMP, {_AUDIT}",
}


@dataclass(frozen=True)
class Unique:
    """Key columns (or expressions) that must not repeat, among rows matching ``where``."""

    table: str
    keys: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str  # restrict, cascade or set_null
    parent_column: str = "id"


@dataclass(frozen=True)
class Check:
    """A row rule; a row breaks it only when the expression is false, not when it is NULL."""

    table: str
    name: str
    expression: str


def one_of(table: str, column: str, *values: str) -> Check:
    listed = ", ".join(f"'{v}'" for v in values)
    return Check(table, f"enum:{column}", f"`{column}` IN ({listed})")


def between(table: str, column: str, low: int, high: int | None = None) -> Check:
    text = f"`{column}` >= {low}" if high is None else f"`{column}` BETWEEN {low} AND {high}"
    return Check(table, f"range:{column}", text)


def ordered(table: str, start: str, end: str) -> Check:
    return Check(table, f"temporal:{start}<={end}", f"`{end}` >= `{start}`")


# The constraints of the metadata tables. Every table with an ``id`` has it unique.
UNIQUE: tuple[Unique, ...] = (
    *[Unique(t, ("id",)) for t, ddl in METADATA_TABLES.items() if ddl.startswith("id ")],
    Unique("users", ("email",)),
    Unique("roles", ("name",)),
    Unique("user_roles", ("user_id", "role_id")),
    Unique("environments", ("slug",)),
    Unique("applications", ("environment_id", "name")),
    Unique("application_components", ("application_id", "name", "component_type")),
    Unique("normalization_rules", ("source_type", "version")),
    Unique("database_targets", ("environment_id", "engine", "host", "port", "coalesce(database_name, '')")),
    Unique("probe_definitions", ("engine", "name", "version")),
    Unique("probe_assignments", ("database_target_id", "probe_definition_id")),
    Unique("investigation_jobs", ("investigation_id", "status"), "status IN ('queued', 'running')"),
    Unique("alert_policies", ("application_id", "name")),
    Unique("adaptive_baselines", ("application_id", "signal_key", "window", "method")),
    Unique("notification_routes", ("application_id", "name")),
    Unique("alert_events", ("application_id", "fingerprint", "started_at")),
    Unique("report_templates", ("name",)),
    Unique("report_schedules", ("application_id", "report_template_id", "cron_expression", "timezone")),
)

FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("user_roles", "user_id", "users", "restrict"),
    ForeignKey("user_roles", "role_id", "roles", "restrict"),
    ForeignKey("applications", "environment_id", "environments", "restrict"),
    ForeignKey("application_components", "application_id", "applications", "restrict"),
    ForeignKey("telemetry_sources", "application_id", "applications", "restrict"),
    ForeignKey("normalization_rules", "created_by", "users", "set_null"),
    ForeignKey("database_targets", "environment_id", "environments", "restrict"),
    ForeignKey("probe_assignments", "database_target_id", "database_targets", "cascade"),
    ForeignKey("probe_assignments", "probe_definition_id", "probe_definitions", "restrict"),
    ForeignKey("investigations", "application_id", "applications", "restrict"),
    ForeignKey("investigations", "environment_id", "environments", "restrict"),
    ForeignKey("investigations", "created_by", "users", "restrict"),
    ForeignKey("investigation_jobs", "investigation_id", "investigations", "cascade"),
    ForeignKey("investigation_results", "investigation_id", "investigations", "cascade"),
    ForeignKey("evidence_links", "investigation_id", "investigations", "cascade"),
    ForeignKey("alert_policies", "application_id", "applications", "restrict"),
    ForeignKey("adaptive_baselines", "application_id", "applications", "cascade"),
    ForeignKey("notification_routes", "application_id", "applications", "restrict"),
    ForeignKey("alert_events", "application_id", "applications", "restrict"),
    ForeignKey("alert_events", "alert_policy_id", "alert_policies", "set_null"),
    ForeignKey("report_schedules", "application_id", "applications", "restrict"),
    ForeignKey("report_schedules", "report_template_id", "report_templates", "restrict"),
    ForeignKey("report_runs", "application_id", "applications", "restrict"),
    ForeignKey("report_runs", "report_schedule_id", "report_schedules", "set_null"),
    ForeignKey("report_runs", "requested_by", "users", "set_null"),
)

_ACTIVE = ("active", "disabled")
_LEVELS = ("info", "warning", "critical")
_PROGRESS = ("queued", "running", "completed", "failed", "cancelled")

CHECKS: tuple[Check, ...] = (
    one_of("users", "status", *_ACTIVE),
    one_of("environments", "type", "production", "staging", "development", "test"),
    one_of("environments", "status", *_ACTIVE),
    one_of("applications", "criticality", "low", "medium", "high", "critical"),
    one_of("applications", "status", *_ACTIVE),
    one_of("telemetry_sources", "ingest_mode", "otlp", "file", "api", "agentless"),
    one_of("telemetry_sources", "status", *_ACTIVE),
    one_of("database_targets", "status", *_ACTIVE),
    between("database_targets", "port", 1, 65535),
    between("probe_definitions", "default_interval_seconds", 1),
    between("probe_definitions", "timeout_ms", 1),
    between("probe_assignments", "interval_seconds", 1),
    one_of("investigations", "status", *_PROGRESS),
    one_of("investigations", "subject_type", "user", "ip", "session", "request"),
    ordered("investigations", "time_start", "time_end"),
    one_of("investigation_jobs", "status", *_PROGRESS),
    one_of("investigation_results", "severity", *_LEVELS),
    one_of("alert_policies", "severity", *_LEVELS),
    one_of("alert_events", "status", "firing", "resolved", "suppressed"),
    one_of("alert_events", "severity", *_LEVELS),
    ordered("alert_events", "started_at", "resolved_at"),
    one_of("report_runs", "status", *_PROGRESS),
    ordered("report_runs", "time_start", "time_end"),
    ordered("report_runs", "started_at", "finished_at"),
)
