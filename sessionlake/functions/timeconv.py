"""Timestamps (Unix milliseconds as doubles), spans and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
#: Numbers below this are seconds.
SECONDS_BELOW = 1e12


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return F.regexp_like(_kind(v), F.lit("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"))


def iso_ms(text: Column) -> Column:
    """ISO-8601 text (without offset: UTC) to milliseconds; anything else null."""
    shaped = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"))
    return F.when(shaped, F.unix_micros(F.try_to_timestamp(text)) / F.lit(1000.0))


def variant_ms(v: Column) -> Column:
    """A variant's time: numbers are milliseconds, texts ISO-8601, true is 1."""
    return (
        F.when(v.isNull() | F.is_variant_null(v), None)
        .when(_is_number(v), F.try_variant_get(v, "$", "double"))
        .when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(_kind(v) == "STRING", iso_ms(F.try_variant_get(v, "$", "string")))
    )


def _is_set(v: Column) -> Column:
    """False for null, 0, false and the empty text."""
    text = F.try_variant_get(v, "$", "string")
    return v.isNotNull() & ~F.is_variant_null(v) & ~F.coalesce((text == "") | (_is_number(v) & (F.try_variant_get(v, "$", "double") == 0)) | ((_kind(v) == "BOOLEAN") & (text == "false")), F.lit(False))


def record_ms(record: Column) -> Column:
    """Time of a message record: its own timestamp, else its message's (an own one that can't be read is null)."""
    own = F.try_variant_get(record, "$.timestamp", "variant")
    inner = F.try_variant_get(record, "$.message.timestamp", "variant")
    return F.when(_is_set(own), variant_ms(own)).otherwise(variant_ms(inner))


def seconds_or_ms(x: Column) -> Column:
    return F.when(x < SECONDS_BELOW, x * 1000.0).otherwise(x)


def envelope_ms(v: Column, read_text: bool = False) -> Column:
    """Time of an envelope: seconds or milliseconds; texts are null unless read_text."""
    number = F.when(_is_number(v), seconds_or_ms(F.try_variant_get(v, "$", "double"))).when(_kind(v) == "BOOLEAN", seconds_or_ms(F.try_variant_get(v, "$", "boolean").cast("double")))
    if not read_text:
        return number
    return F.coalesce(number, F.when(_kind(v) == "STRING", iso_ms(F.try_variant_get(v, "$", "string"))))


def days_ago(ms: Column, now_ms: Column | float) -> Column:
    now = now_ms if isinstance(now_ms, Column) else F.lit(float(now_ms))
    return F.when(ms != 0, F.round((now - ms) / DAY_MS, 1))


def span_weeks(first: Column, last: Column) -> Column:
    return F.when(last > first, F.round((last - first) / WEEK_MS, 1))


def megabytes(n: Column) -> Column:
    return F.round(n / F.lit(1048576.0), 2)


def recent(ms: Column, days: int | None, now_ms: float) -> Column:
    """True for times in the last `days` days; always where days is none or not above 0."""
    if not days or days <= 0:
        return F.lit(True)
    return ms >= F.lit(float(now_ms) - days * DAY_MS)
