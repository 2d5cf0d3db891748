"""Timestamps, durations and step arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: an RFC 3339 instant. The zone is mandatory, the hour may have one
# digit, the fraction may follow a comma.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]([01]\d|2[0-4]):([0-5]\d|60))$"

# Microseconds per duration unit.
UNIT_MICROS = {"ns": 0.001, "us": 1.0, "µs": 1.0, "μs": 1.0, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6}

_NUMBER = r"(?:\d+\.?\d*|\.\d+)"
_UNIT = r"(?:ns|us|µs|μs|ms|s|m|h)"


def parse_rfc3339(c: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL when the text is not one.

    The zone offset is subtracted here because a cast only takes offsets up to 18 hours.
    """
    zulu = c.endswith("Z")
    n = F.length(c)
    local = F.when(zulu, F.left(c, n - 1)).otherwise(F.left(c, n - 6))
    sign = F.when(F.substr(c, n - 5, F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.substr(c, n - 4, F.lit(2)).try_cast("long")
    minutes = F.substr(c, n - 1, F.lit(2)).try_cast("long")
    offset = F.when(zulu, F.lit(0).cast("long")).otherwise(sign * (hours * 3600 + minutes * 60))
    local_ts = F.concat(F.translate(local, ",", "."), F.lit("Z")).try_cast("timestamp")
    return F.when(c.rlike(RFC3339), F.timestamp_micros(F.unix_micros(local_ts) - offset * 1000000))


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration such as ``1h30m`` or ``-1.5s``; NULL when malformed.

    Digits below one microsecond are kept as a fraction of a second.
    """
    body = F.regexp_replace(c, r"^[+-]", "")
    parts = F.regexp_extract_all(body, F.lit(f"({_NUMBER}{_UNIT})"), 1)

    def micros(part: Column) -> Column:
        unit = F.regexp_extract(part, f"({_UNIT})$", 1)
        scale = F.lit(None).cast("double")
        for name, value in UNIT_MICROS.items():
            scale = F.when(unit == name, F.lit(value)).otherwise(scale)
        return F.regexp_extract(part, f"^({_NUMBER})", 1).cast("double") * scale

    total = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + micros(part))
    sign = F.when(c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(body == "0", F.lit(0.0))
        .when(body.rlike(f"^({_NUMBER}{_UNIT})+$"), sign * total / 1e6)
    )


def floor_div(a: Column, b: int) -> Column:
    """Largest whole k with k*b <= a, exact for 64-bit values."""
    width = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, width), width)


def ceil_div(a: Column, b: int) -> Column:
    """Smallest whole k with k*b >= a, exact for 64-bit values."""
    return -floor_div(-a, b)
