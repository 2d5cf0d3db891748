"""Label maps. A map cannot be grouped on, so it is turned into sorted text first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def label_names(labels: Column) -> Column:
    """Sorted, comma-joined label names."""
    return F.coalesce(F.array_join(F.array_sort(F.map_keys(labels)), ","), F.lit(""))


def label_text(labels: Column) -> Column:
    """Sorted JSON entries of a label map, usable as a group key."""
    entries = F.array_sort(F.map_entries(labels))
    return F.coalesce(F.to_json(entries), F.lit("[]"))


def label_pairs(labels: Column) -> Column:
    """Readable ``k=v`` text, sorted by name."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def series_id(metric: Column, labels: Column) -> Column:
    """Stable identity of a series: metric name and full label set."""
    return F.sha2(F.concat(F.to_json(F.array(metric)), label_text(labels)), 256)


def fingerprint(names: Sequence[str], alert: Column | None = None) -> Column:
    """Identity of an alert from its label columns, sorted by name."""
    entries = [F.struct(F.lit(n).alias("key"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value")) for n in sorted(names)]
    text = F.to_json(F.array(*entries))
    return F.sha2(text if alert is None else F.concat(F.to_json(F.array(alert)), text), 256)
