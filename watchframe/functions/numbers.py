"""Numeric text: what counts as a number, and how a number is written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    BinaryType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
)

# Texts that parse as a 64-bit float.
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_TEXT = r"^(?:[+-]?(?i:inf|infinity)|(?i:nan))$"
HEX_TEXT = r"^[+-]?0[xX](?=[0-9a-fA-F.])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?\d+)$"


def parse_number(c: Column) -> Column:
    """Double of a numeric text, NULL when it is not one or is out of range."""
    plain = c.try_cast("double")
    special = (
        F.when(F.lower(c).contains("nan"), F.lit(float("nan")))
        .when(c.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    whole, frac = F.regexp_extract(c, HEX_TEXT, 1), F.regexp_extract(c, HEX_TEXT, 2)
    digits = F.regexp_replace(F.concat(whole, frac), "^0+", "")
    # 60 bits and a mark for what follows them round to a double as the whole number would
    head, rest = F.substring(digits, 1, 15), F.substring(digits, 16, 1_000_000_000)
    mark = F.when(rest.rlike("[^0]"), 1).otherwise(0)
    mantissa = F.coalesce(F.conv(head, 16, 10).try_cast("bigint").bitwiseOR(mark.cast("bigint")), F.lit(0).cast("bigint")).cast("double")
    exponent = F.regexp_extract(c, HEX_TEXT, 3).try_cast("int") - F.length(frac) * 4 + F.length(rest) * 4
    sign = F.when(c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    hexed = sign * mantissa * F.pow(F.lit(2.0), exponent)
    hex_ok = c.rlike(HEX_TEXT) & (F.length(whole) + F.length(frac) > 0)
    return (
        F.when(c.rlike(DECIMAL_TEXT), F.when(F.abs(plain) <= F.lit(1.7976931348623157e308), plain))
        .when(c.rlike(SPECIAL_TEXT), special)
        .when(hex_ok, F.when(F.abs(hexed) <= F.lit(1.7976931348623157e308), hexed))
    )


def to_sample_value(c: Column, dtype: DataType) -> Column | None:
    """Sample value of a probe column, or None when its type never holds a number.

    Booleans and timestamps are not numbers here.
    """
    if isinstance(dtype, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)):
        return c.cast("double")
    if isinstance(dtype, (StringType, BinaryType)):
        return parse_number(c.cast("string"))
    return None


def plain_number_text(x: Column, low: float = 1e-6, high: float = 1e21) -> Column:
    """Shortest text of a double, in plain notation between ``low`` and ``high``.

    Outside that range the exponent form ``1e-07`` is written without padding: ``1e-7``, ``1e+21``.
    """
    text = x.cast("string")
    a = F.abs(x)
    whole = (x == F.floor(x)) & (a < F.lit(1e15))
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", "")
    tiny = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,30)").cast("string"), r"0+$", ""), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), r"E(\d)", r"e+$1")
    return (
        F.when(x == 0, F.lit("0"))
        .when(whole, x.try_cast("long").cast("string"))
        .when((a < low) | (a >= high), exponent)
        .when(a < 1, tiny)
        .otherwise(plain)
    )
