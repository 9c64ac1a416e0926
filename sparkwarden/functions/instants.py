"""Zoned timestamps from log text, exact to the nanosecond.

Spark's own cast accepts text without a zone and cuts everything below a
microsecond, so the text is matched first and the digits 7-9 of the fraction
are read apart. ``event_ns`` (nanoseconds since 1970, BIGINT) then orders and
subtracts exactly; it is NULL outside the years 1678-2261.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})\z"

NANOS_PER_SECOND = 1_000_000_000
NANOS_PER_HOUR = 3600 * NANOS_PER_SECOND


@dataclass(frozen=True)
class Instant:
    """Columns for one timestamp text."""

    time: Column  # TIMESTAMP, NULL where absent or refused
    nanos: Column  # 0..999 below the microsecond, NULL with no text
    refused: Column  # text present but not acceptable


def extended(text: Column) -> Column:
    """ISO 8601 basic forms (``20250203T120000Z``, zones ``+0000`` and ``+00``) written out
    as ``ISO_ZONED`` wants them, with the seconds that Spark's cast needs; any other text
    stays as it is."""
    day = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=[T ])", "$1-$2-$3")
    head, zone = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})", r"(?=Z\z|[+-][\d:]+\z)"
    clock = F.regexp_replace(day, head + r"(\d{2})(\d{2}(?:\.\d+)?)" + zone, "$1:$2:$3")
    clock = F.regexp_replace(clock, head + r":?(\d{2})" + zone, "$1:$2:00")
    zoned = F.regexp_replace(clock, r"(:[\d.]+[+-]\d{2})(\d{2})\z", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(:[\d.]+[+-]\d{2})\z", "$1:00")
    usual = text.rlike(r"^.{10}[T ]\d{2}:\d{2}:") & text.rlike(ISO_ZONED)
    return F.when(usual, text).otherwise(zoned)


def instant(text: Column, pattern: str = RFC3339, keep_nanos: bool = True) -> Instant:
    shaped = text.rlike(pattern)
    time = F.when(shaped, F.try_to_timestamp(text))
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    nanos = F.when(
        text.isNotNull(),
        F.substring(F.rpad(fraction, 9, "0"), 7, 3).cast("int") if keep_nanos else F.lit(0),
    )
    return Instant(time, nanos, text.isNotNull() & time.isNull())


def epoch_nanos(time: Column, nanos: Column) -> Column:
    return F.try_add(F.try_multiply(F.unix_micros(time), F.lit(1000)), nanos.cast("bigint"))


def seconds_between(start_ns: Column, end_ns: Column) -> Column:
    """Elapsed seconds as DOUBLE."""
    return (end_ns - start_ns) / F.lit(float(NANOS_PER_SECOND))
