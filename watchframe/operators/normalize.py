"""Raw JSON events to one typed contract, with explicit rejects.

``normalize`` keeps every input row and adds the contract columns plus
``reject_reason``; ``accepted`` and ``rejected`` split on it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.functions.numbers import plain_number_text
from watchframe.functions.text import blank_to_null, trim_space
from watchframe.functions.timeparse import parse_rfc3339

# The keys a field is read from, in order of preference.
FIELD_KEYS: dict[str, tuple[str, ...]] = {
    "environment": ("environment", "env"),
    "application": ("application", "app", "module"),
    "component": ("component", "action", "screen", "operation"),
    "platform": ("platform",),
    "severity": ("severity", "level"),
    "message": ("message", "msg", "text"),
    "user_id": ("user_id", "userId", "user"),
    "session_id": ("session_id", "sessionId", "session"),
    "request_id": ("request_id", "requestId", "trace_id", "traceId"),
    "client_ip": ("client_ip", "clientIp", "ip"),
    "timestamp": ("timestamp", "time"),
}
REQUIRED_FIELDS = ("environment", "application", "message")
OPTIONAL_FIELDS = ("component", "platform", "user_id", "session_id", "request_id", "client_ip")
ENVELOPE = ("timestamp", "environment", "application", "component", "platform", "severity", "message",
            "user_id", "session_id", "request_id", "client_ip", "labels")

SEVERITIES = ("debug", "info", "warning", "error", "critical")  # counted by name while events are written, others together

# Texts of the reasons an event is rejected.
REJECT_PARSE = "parse application event"
REJECT_TIMESTAMP = "timestamp must be RFC3339"
REJECT_REQUIRED = "environment, application, and message are required"

# Every key is parsed as a VARIANT of its own, which keeps its JSON type: one pass, no look-ups.
_BAD = "_bad"
_JSON_OPTIONS = {
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
}
_JSON_SPACE = " \t\n\r"

# Without either, a number has fewer than 309 digits before its point once its exponent is applied.
_MAY_OVERFLOW = r"\d[eE]\+?\d{2}|\d{290}"
_STRING_LITERAL = r'"(?:[^"\\]|\\.)*"'


def _value_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def first_string(keys: Sequence[str]) -> Column:
    """The first key that holds a string wins, trimmed, even when it trims to nothing."""
    options = [f"CASE WHEN schema_of_variant(`{k}`) = 'STRING' THEN CAST(`{k}` AS STRING) END" for k in keys]
    return trim_space(F.expr(f"coalesce({', '.join(options)}, '')"))


def scalar_labels(labels: Column) -> Column:
    """String, number and boolean entries of a label object; NULL when there are none."""
    is_object = _value_type(labels).startswith("OBJECT")
    entries = F.when(is_object, F.try_variant_get(labels, "$", "map<string,variant>"))
    # OBJECT, ARRAY and VOID values go
    kept = F.map_filter(entries, lambda _, v: ~F.left(_value_type(v), F.lit(2)).isin("OB", "AR", "VO"))
    return F.when(F.size(kept) > 0, kept)


def _has_overflow(value: Column) -> Column:
    """True when a number of the document is too large for a 64-bit float.

    Texts without an exponent of two digits or a very long number, that is nearly all, stop at the first test.
    """
    numbers = F.regexp_extract_all(
        F.regexp_replace(value, _STRING_LITERAL, '""'), F.lit(r"(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1
    )
    return F.when(
        value.rlike(_MAY_OVERFLOW),
        F.exists(numbers, lambda x: x.try_cast("double") == F.lit(float("inf"))),
    ).otherwise(F.lit(False))


def field_keys_of(rule_config: str) -> dict[str, tuple[str, ...]]:
    """The keys with those of a stored normalisation rule put in their place, e.g. ``{"message": ["msg"]}``."""
    return {**FIELD_KEYS, **{name: tuple(keys) for name, keys in json.loads(rule_config).items()}}


def normalize(
    raw: DataFrame,
    ingest_ts: str | Column = "ingest_ts",
    value: str = "value",
    field_keys: Mapping[str, Sequence[str]] = FIELD_KEYS,
) -> DataFrame:
    """Add the contract columns and ``reject_reason`` (NULL when accepted) to raw JSON rows.

    ``ingest_ts`` stands in for a missing timestamp, so a rerun gives the same result.
    Checks run in this order: parse, timestamp, required fields.
    """
    ingest = F.col(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    passthrough = [F.col(f"`{c}`") for c in raw.columns if c not in ENVELOPE]
    kept = [F.col(f"_raw.`{c}`") for c in raw.columns if c not in ENVELOPE]
    names = sorted({k for keys in field_keys.values() for k in keys} | {"labels"})
    schema = ", ".join([*[f"`{k}` VARIANT" for k in names], f"`{_BAD}` STRING"])
    opening = F.left(F.ltrim(F.col(value), F.lit(_JSON_SPACE)), F.lit(1))
    parsed = raw.select(
        F.struct(*passthrough).alias("_raw"),
        ingest.alias("_ingest"),
        opening.alias("_opening"),
        _has_overflow(F.col(value)).alias("_overflow"),
        # a bare null counts as an empty object
        F.when(opening == "n", _value_type(F.try_parse_json(F.col(value))) == "VOID").alias("_null"),
        F.from_json(F.col(value), schema, _JSON_OPTIONS).alias("_doc"),
    ).select("_raw", "_ingest", "_opening", "_overflow", "_null", "_doc.*")
    is_object = ((F.col("_opening") == "{") & F.col(_BAD).isNull()) | F.col("_null")
    texts = parsed.select(
        *kept,
        "_ingest",
        F.coalesce(is_object, F.lit(False)).alias("_object"),
        "_overflow",
        scalar_labels(F.col("labels")).alias("_labels"),
        *[first_string(keys).alias(f"_{name}") for name, keys in field_keys.items()],
    )
    stamped = texts.withColumn(
        "_ts", F.when(F.col("_timestamp") == "", F.col("_ingest")).otherwise(parse_rfc3339(F.col("_timestamp")))
    )
    missing = F.lit(False)
    for name in REQUIRED_FIELDS:
        missing = missing | (F.col(f"_{name}") == "")
    reason = (
        F.when(~F.col("_object") | F.col("_overflow"), F.lit(REJECT_PARSE))
        .when(F.col("_ts").isNull(), F.lit(REJECT_TIMESTAMP))
        .when(missing, F.lit(REJECT_REQUIRED))
    )
    severity = F.lower(F.col("_severity"))
    # Filters on a generator's output stay above it, so neither splitting accepted from rejected rows
    # nor a later filter on a field evaluates the JSON parsing below a second time. The labels are the
    # costly part and stay outside, where an unused column is pruned.
    fields = F.struct(
        F.col("_ts").alias("timestamp"),
        *[F.col(f"_{name}").alias(name) for name in REQUIRED_FIELDS],
        *[blank_to_null(F.col(f"_{name}")).alias(name) for name in OPTIONAL_FIELDS],
        F.when(severity == "", F.lit("info")).otherwise(severity).alias("severity"),
        reason.alias("reject_reason"),
    )
    checked = stamped.select(*passthrough, F.col("_labels").alias("labels"), F.inline(F.array(fields)))
    return checked.select(*passthrough, *ENVELOPE, "reject_reason")


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(normalized: DataFrame, *keep: str) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")


def variant_text(v: Column) -> Column:
    """Label value as text: numbers in shortest form, strings and booleans as they are."""
    kind = F.schema_of_variant(v)
    is_number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    return F.when(is_number, plain_number_text(v.cast("double"))).otherwise(v.cast("string"))


def text_labels(labels: Column) -> Column:
    """Labels as MAP<STRING,STRING>."""
    return F.transform_values(labels, lambda _, v: variant_text(v))


def envelope_json(events: DataFrame) -> Column:
    """The accepted event as JSON text; empty optional fields are left out."""
    fields = []
    for name in ENVELOPE:
        if name == "timestamp":
            whole = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
            frac = F.regexp_replace(F.date_format("timestamp", ".SSSSSS"), r"\.?0+$", "")
            fields.append(F.concat(whole, frac, F.lit("Z")).alias(name))
        else:
            fields.append(F.col(name))
    return F.to_json(F.struct(*fields))


def count_accepted(
    events: DataFrame, keys: Sequence[str] = ("environment", "application", "severity"), window: str | None = None
) -> DataFrame:
    """Accepted events per label set and, when asked for, per time window."""
    groups: list[Column] = [F.col(k) for k in keys]
    if window:
        groups.append(F.window("timestamp", window)["start"].alias("window_start"))
    return events.groupBy(*groups).agg(F.count("*").alias("n_events"))


def severity_counters(severities: Sequence[str] = SEVERITIES) -> list[Column]:
    """Numbers of events per severity, for ``observe``: ``n_0``, ``n_1`` ... in the order given, the last for all others."""
    severity = F.col("severity")
    known = F.coalesce(severity.isin(*severities), F.lit(False))
    return [F.count_if(c).alias(f"n_{i}") for i, c in enumerate([*[severity == s for s in severities], ~known])]


def alert_deliveries(raw: DataFrame, value: str = "value") -> DataFrame:
    """Alert deliveries with ``accepted``: any JSON object counts, and so does ``null``."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(value)))
    ok = F.coalesce(kind.startswith("OBJECT") | (kind == "VOID"), F.lit(False)) & ~_has_overflow(F.col(value))
    return raw.withColumn("accepted", ok)


def count_deliveries(deliveries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return deliveries.filter("accepted").groupBy(*keys).agg(F.count("*").alias("n_deliveries"))
