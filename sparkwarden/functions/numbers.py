"""Number helpers with SQL-engine-neutral results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer_from_text(text: Column) -> Column:
    """Integer from decimal or exponent text ('22.5' -> 23, '1e2' -> 100), else NULL.

    Spark's own ``try_cast`` to INT refuses both forms."""
    return F.round(text.try_cast("double")).try_cast("int")


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Rounded quotient, NULL on a zero denominator."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), digits)
