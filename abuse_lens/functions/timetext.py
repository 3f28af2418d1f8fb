"""Clock text that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ntz_from_seconds(seconds: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def micros_from_ntz(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, read field by field.

    ``timestampdiff`` goes through the session zone and moves the hour that a
    clock change skips.
    """
    t = ts.cast("timestamp_ntz")
    whole = lambda c, unit: c.cast("bigint") * F.lit(unit).cast("bigint")
    seconds = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return (
        whole(F.unix_date(t.cast("date")), 86_400_000_000)
        + whole(F.hour(t), 3_600_000_000)
        + whole(F.minute(t), 60_000_000)
        + seconds
    )


def seconds_from_ntz(ts: Column) -> Column:
    return F.call_function("div", micros_from_ntz(ts), F.lit(1_000_000).cast("bigint"))


def hour_name(seconds: Column) -> Column:
    """UTC hour as ``yyyyMMddHH``."""
    digits = F.translate(ntz_from_seconds(seconds).cast("string"), "-: ", "")
    return F.substring(digits, 1, 10)


def run_dir_name(seconds: Column) -> Column:
    """UTC second as ``yyyyMMdd-HHmmssZ``."""
    digits = F.translate(ntz_from_seconds(seconds).cast("string"), "-: ", "")
    return F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 6), F.lit("Z"))


def hour_seconds(hour: Column) -> Column:
    """Start of a ``yyyyMMddHH`` hour in epoch seconds; null when it is no such hour."""
    part = lambda at, n: F.substring(hour, at, n).cast("int")
    moment = F.try_make_timestamp_ntz(
        part(1, 4), part(5, 2), part(7, 2), part(9, 2), F.lit(0), F.lit(0).cast("decimal(8,6)")
    )
    return F.when(hour.rlike(r"^\d{10}$"), seconds_from_ntz(moment))
