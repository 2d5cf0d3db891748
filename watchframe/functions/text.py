"""String and URL column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Prefixes that mark a secret reference.
SECRET_PREFIXES = ("kv/", "secret/", "env/")


def trim_space(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends.

    Text between two printable ASCII characters, the usual case, is passed on as it is.
    """
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """The first column that is neither NULL nor empty, else an empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def is_secret_ref(c: Column) -> Column:
    test = F.lit(False)
    for prefix in SECRET_PREFIXES:
        test = test | c.startswith(prefix)
    return test


def redact_ref(c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.concat(c, F.lit(":<redacted>")))


def is_absolute_url(c: Column) -> Column:
    """True when the text parses as a URL with both a scheme and a host."""
    return F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(c, F.lit("HOST")).isNotNull()


def percent_encode(c: Column) -> Column:
    """URL-encode with %20 for a blank."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def fill_dollar_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace every ``${name}`` by the percent-encoded value of that name."""
    for name, value in values.items():
        encoded = F.coalesce(percent_encode(value.cast("string")), F.lit(""))
        template = F.replace(template, F.lit("${" + name + "}"), encoded)
    return template


def fill_label_template(template: Column, labels: Mapping[str, Column]) -> Column:
    """Replace every ``{{ $labels.name }}`` by the label value, blanks inside the braces optional."""
    for name, value in labels.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        # a value may hold $ or \\, which a regex replacement would read as group references
        safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        template = F.regexp_replace(template, F.lit(r"\{\{\s*\$labels\." + name + r"\s*\}\}"), safe)
    return template


def error_shape(message: Column) -> Column:
    """Message with the varying parts (uuids, hex runs, numbers) masked."""
    masked = F.lower(message)
    masked = F.regexp_replace(masked, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    masked = F.regexp_replace(masked, r"0x[0-9a-f]+", "<hex>")
    return F.regexp_replace(masked, r"[0-9]+", "<n>")
