"""The accepted timestamp text, as a Column expression and for the driver.

``YYYY-MM-DDTHH:MM:SS[.1-9 digits](Z|+HH:MM|+HHMM)``; digits beyond
microseconds are cut off.  Zone offsets reach 23:59, further than Spark's own
cast allows, so the offset is subtracted separately.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOUR, _SIXTY = r"([01]\d|2[0-3])", r"[0-5]\d"
_DAY = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_SHAPE = rf"{_DAY}T{_HOUR}:{_SIXTY}:{_SIXTY}(\.\d{{1,9}})?(Z|[+-]{_HOUR}:?{_SIXTY})"
# \z, because $ would also match before a final line break.
_ANCHORED = rf"\A{_SHAPE}\z"
_ZONE = r"[+-]\d{2}:?\d{2}\z"

_PARTS = re.compile(
    r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:Z|([+-])(\d\d):?(\d\d))",
    re.ASCII,
)
_FULL = re.compile(_SHAPE, re.ASCII)
_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()
_DAYS_IN_400_YEARS = 146_097


def iso_timestamp(text: Column) -> Column:
    """The instant ``text`` names, or NULL when it is not acceptable."""
    utc = text.try_cast("timestamp")
    local = F.regexp_replace(text, _ZONE, "Z").try_cast("timestamp")
    # +0530 as a number; both parts keep its sign
    zone = F.replace(F.regexp_extract(text, _ZONE, 0), F.lit(":"), F.lit("")).cast("int")
    minutes = zone % 100
    offset = (zone - minutes) * 36 + minutes * 60
    shifted = F.timestamp_add("SECOND", -offset, local)
    return F.when(
        text.rlike(_ANCHORED), F.when(text.endswith("Z"), utc).otherwise(shifted)
    )


def iso_millis_text(timestamp: Column) -> Column:
    """Output form of an instant: UTC, milliseconds, ``Z``."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros_text(timestamp: Column) -> Column:
    """Cursor form of an instant: all stored digits, so no row can be skipped."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_date(timestamp: Column) -> Column:
    """The UTC date of an instant, in any session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(timestamp) / 86_400).cast("int"))


def parse_iso_micros(text: str) -> int | None:
    """Microseconds since 1970 for query parameters, or None."""
    if not _FULL.fullmatch(text):
        return None
    year, month, day, hour, minute, second, fraction, sign, zh, zm = _PARTS.fullmatch(text).groups()
    try:
        days = day_number(f"{year}-{month}-{day}")
    except ValueError:
        return None
    seconds = (days * 24 + int(hour)) * 3600 + int(minute) * 60 + int(second)
    if sign:
        offset = int(zh) * 3600 + int(zm) * 60
        seconds += offset if sign == "-" else -offset
    return seconds * 1_000_000 + int((fraction or "").ljust(6, "0")[:6])


def day_number(text: str) -> int:
    """Days since 1970-01-01 of a date; unlike Python's, years may be 0 or less."""
    year, month, day = text.rsplit("-", 2)
    cycles = max(0, -((int(year) - 1) // 400))  # the calendar repeats every 400 years
    date = dt.date(int(year) + 400 * cycles, int(month), int(day))
    return date.toordinal() - _DAYS_IN_400_YEARS * cycles - _EPOCH_DAY


def day_text(day: int) -> str:
    """The date of a day number, as Spark writes it."""
    ordinal = day + _EPOCH_DAY
    cycles = max(0, -((ordinal - 1) // _DAYS_IN_400_YEARS))
    date = dt.date.fromordinal(ordinal + _DAYS_IN_400_YEARS * cycles)
    year = date.year - 400 * cycles
    return f"{'-' if year < 0 else ''}{abs(year):04d}-{date:%m-%d}"


def micros_literal(micros: int) -> Column:
    """An instant literal; Catalyst folds it, so it reaches the Parquet filter."""
    return F.timestamp_micros(F.lit(micros).cast("long"))


def micros_of(moment: dt.datetime) -> int:
    """Microseconds since 1970; a datetime without zone is taken as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
