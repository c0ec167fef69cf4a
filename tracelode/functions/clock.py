"""Time functions over integer microseconds since the epoch (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def seconds_to_us(seconds: Column) -> Column:
    """Epoch seconds held as a double to whole microseconds."""
    return F.round(seconds * F.lit(1e6)).cast("bigint")


def to_us(ts: Column) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ (read as UTC) to microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def to_ts(us: Column) -> Column:
    return F.timestamp_micros(us)


def iso_utc(us: Column) -> Column:
    """ISO text with offset; the fraction is left out when it is zero."""
    whole = F.date_format(to_ts(us), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(us, F.lit(SECOND))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))


def floor_us(us: Column, width: int) -> Column:
    """Start of the fixed-width slot that holds ``us``."""
    return us - F.pmod(us, F.lit(width))


def printed_equals(date: Column, time: Column, us: Column) -> Column:
    """True when printed date and time are the UTC second of ``us``."""
    return F.concat(date, F.lit("T"), time) == F.date_format(to_ts(us), "yyyy-MM-dd'T'HH:mm:ss")


def off_hours(us: Column, tz: str, start_hour: int, end_hour: int) -> Column:
    """True outside ``[start_hour, end_hour)`` of the local day in ``tz``."""
    hour = F.hour(F.from_utc_timestamp(to_ts(us), tz))
    return (hour < start_hour) | (hour >= end_hour)
