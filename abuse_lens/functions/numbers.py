"""Guarded arithmetic and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(amount: Column, seconds) -> Column:
    """Amount per second, 0.0 over an empty window."""
    per = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.when(per > 0, amount.cast("double") / per.cast("double")).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 when there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, null when there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def saturating_sub(now: Column, before: Column) -> Column:
    """now - before, never below 0, null when either side is null."""
    return F.when(now.isNotNull() & before.isNotNull(), F.greatest(now - before, F.lit(0).cast("bigint")))


def fixed(value: Column, decimals: int) -> Column:
    """Decimal text rounded half-even on the exact binary value.

    ``format_string`` rounds the shortest decimal half-up instead, which gives
    0.3 for 0.25; a DecimalFormat pattern works on the exact double.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))
