"""Log policy: which attributes may become labels, and which records are refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.operators.normalize import envelope_json, text_labels

# Per-request identities that must not become labels.
HIGH_CARDINALITY = ("user_id", "session_id", "request_id", "client_ip")
# Limits of the log store.
MAX_LABEL_NAMES = 15
MAX_LABEL_LENGTH = 256
MAX_AGE_HOURS = 168

REJECT_LABEL_COUNT = "too many label names"
REJECT_LABEL_LENGTH = "label value too long"
REJECT_TOO_OLD = "too old"


def upsert_label(labels: Column, name: str, value: str) -> Column:
    """Set one constant entry on every record, replacing an earlier value."""
    rest = F.map_filter(labels, lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), F.lit(value)))


def drop_labels(labels: Column, names: Sequence[str] = HIGH_CARDINALITY) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def log_records(
    events: DataFrame, job: str, resource: tuple[str, str] | None = None, attributes: Sequence[str] = HIGH_CARDINALITY
) -> DataFrame:
    """Log records of accepted events: low-cardinality labels, identities only in the body.

    ``attributes`` are first merged into the label map the way a raw record carries them, then the
    policy removes the high-cardinality ones again, whether they came from the event or its labels.
    """
    own = F.map_from_entries(
        F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value"))
                  for n in ("environment", "application", "component", "platform", *attributes)])
    )
    event_labels = F.coalesce(text_labels(F.col("labels")), F.expr("cast(map() as map<string,string>)"))
    clash = F.map_filter(event_labels, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    merged = F.map_concat(F.map_filter(own, lambda _, v: v.isNotNull()), clash)
    if resource:
        merged = upsert_label(merged, *resource)
    keep = [c for c in events.columns if c in ("event_id", "ingest_ts")]
    return events.select(
        *keep,
        F.col("timestamp").alias("ts"),
        F.lit(job).alias("job"),
        F.col("severity").alias("level"),
        drop_labels(merged).alias("labels"),
        envelope_json(events).alias("body"),
    )


def label_limit_reason(
    labels: Column, max_names: int = MAX_LABEL_NAMES, max_length: int = MAX_LABEL_LENGTH
) -> Column:
    too_long = F.exists(F.map_values(labels), lambda v: F.length(v) > max_length)
    return (
        F.when(F.size(labels) > max_names, F.lit(REJECT_LABEL_COUNT))
        .when(F.coalesce(too_long, F.lit(False)), F.lit(REJECT_LABEL_LENGTH))
    )


def too_old_reason(ts: Column, ingest_ts: Column, max_age_hours: int = MAX_AGE_HOURS) -> Column:
    return F.when(ts < ingest_ts - F.expr(f"INTERVAL {int(max_age_hours)} HOURS"), F.lit(REJECT_TOO_OLD))


def apply_log_policy(records: DataFrame, ingest_ts: Column | None = None, **limits: int) -> DataFrame:
    """Add ``reject_reason``; NULL rows may be stored."""
    reasons = [label_limit_reason(F.col("labels"), **limits)]
    if ingest_ts is not None:
        reasons.insert(0, too_old_reason(F.col("ts"), ingest_ts))
    return records.withColumn("reject_reason", F.coalesce(*reasons))
