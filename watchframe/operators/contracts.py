"""Conformance of JSON payloads to the published contracts, as rows of broken rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.functions.text import is_absolute_url
from watchframe.functions.timeparse import parse_rfc3339

STRING, OBJECT, TIME = {"type": "string"}, {"type": "object"}, {"type": "string", "format": "date-time"}
UUID = {"type": "string", "format": "uuid"}

# The four payload contracts. Every object is closed unless it has no "properties".
CONTRACTS: dict[str, dict[str, Any]] = {
    "application_event": {
        "required": ["timestamp", "environment", "application", "severity", "message"],
        "properties": {
            "timestamp": TIME, "environment": STRING, "application": STRING, "component": STRING,
            "platform": STRING, "severity": STRING, "message": STRING, "user_id": STRING,
            "session_id": STRING, "request_id": STRING, "client_ip": STRING,
            "labels": {"type": "object", "values": ["string", "number", "boolean"]},
        },
    },
    "alert_evidence": {
        "required": ["source_type", "title", "url"],
        "properties": {
            "source_type": STRING, "title": STRING, "url": {"type": "string", "format": "uri"},
            "time_start": TIME, "time_end": TIME, "metadata": OBJECT,
        },
    },
    "session_investigation": {
        "required": ["application_id", "time_start", "time_end"],
        "properties": {
            "application_id": UUID, "environment_id": UUID, "user_id": STRING, "ip": STRING,
            "session_id": STRING, "request_id": STRING, "time_start": TIME, "time_end": TIME,
        },
    },
    "report_payload": {
        "required": ["application_id", "period", "sections"],
        "properties": {
            "application_id": UUID,
            "period": {"type": "object", "required": ["start", "end"], "properties": {"start": TIME, "end": TIME}},
            "sections": {
                "type": "array",
                "items": {"type": "object", "required": ["id", "title"],
                          "properties": {"id": STRING, "title": STRING, "data": {}}},
            },
        },
    },
}

_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_type(v: Column) -> Column:
    """JSON type name of a variant; NULL for a missing value."""
    return _once(F.schema_of_variant(v), _type_name)


def _type_name(kind: Column) -> Column:
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.isNotNull(), "number")
    )


def _format_ok(text: Column, name: str) -> Column:
    if name == "date-time":
        return _once(text, lambda t: parse_rfc3339(t).isNotNull())
    if name == "uuid":
        return text.rlike(_UUID)
    return _once(text, is_absolute_url)


def _broken_rules(v: Column, spec: Mapping[str, Any], path: str) -> Column:
    """Array of rule names broken by the present value ``v``."""
    if not spec:
        return F.expr(_NO_RULES)
    return _once(json_type(v), lambda kind: _rules_of_type(v, kind, spec, path))


def _rules_of_type(v: Column, kind: Column, spec: Mapping[str, Any], path: str) -> Column:
    rules: list[Column] = []

    def rule(broken: Column, name: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(f"{name}:{path}" if path else name)))

    if "type" in spec:
        rules.append(rule(kind != spec["type"], "type"))
    if "format" in spec:
        text = F.try_variant_get(v, "$", "string")
        rules.append(rule((kind == "string") & ~F.coalesce(_format_ok(text, spec["format"]), F.lit(False)), "format"))
    if "values" in spec or "properties" in spec:
        entries = F.when(kind == "object", F.try_variant_get(v, "$", "map<string,variant>"))
        rules.append(_once(entries, lambda m: _rules_of_entries(v, m, spec, path, rule)))
    if "items" in spec:
        items = F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>"))
        per_item = F.transform(items, lambda x: _broken_rules(x, spec["items"], f"{path}[]"))
        rules.append(F.array_distinct(F.flatten(per_item)))
    return _merge(rules)


def _rules_of_entries(v: Column, entries: Column, spec: Mapping[str, Any], path: str, rule: Callable[[Column, str], Column]) -> Column:
    rules: list[Column] = []
    if "values" in spec:
        rules.append(rule(F.exists(F.map_values(entries), lambda x: ~json_type(x).isin(*spec["values"])), "value_type"))
    if "properties" in spec:
        inner = f"{path}." if path else ""
        rules.append(_once(F.map_keys(entries), lambda keys: _merge([
            *[F.when(~F.array_contains(keys, name), F.array(F.lit(f"required:{inner}{name}"))) for name in spec.get("required", ())],
            rule(F.size(F.array_except(keys, F.array(*[F.lit(p) for p in spec["properties"]]))) > 0, "additional")])))
        for name, child in spec["properties"].items():
            value = F.try_variant_get(v, f"$.{name}", "variant")
            rules.append(_once(value, _rules_if_present(child, f"{inner}{name}")))
    return _merge(rules)


def _rules_if_present(spec: Mapping[str, Any], path: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNotNull(), _broken_rules(v, spec, path))


_NO_RULES = "cast(array() as array<string>)"


def _merge(rules: list[Column]) -> Column:
    empty = F.expr(_NO_RULES)
    return F.concat(empty, *[F.coalesce(r, empty) for r in rules])


def broken_rules(value: Column, contract: str) -> Column:
    """Array of broken rules of a JSON text; ``parse`` when it is no JSON at all.

    The text is parsed once, and so is the type of each value in it.
    """
    spec = {"type": "object", **CONTRACTS[contract]}
    return _once(F.try_parse_json(value), lambda doc: F.when(
        doc.isNull() & F.schema_of_variant(doc).isNull(), F.array(F.lit("parse"))).otherwise(_broken_rules(doc, spec, "")))


def contract_violations(df: DataFrame, contract: str, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per broken rule."""
    return df.select(*keep, F.explode(broken_rules(F.col(value), contract)).alias("rule"))
