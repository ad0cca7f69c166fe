"""Dates: epoch numbers to ISO text, precision-aware bounds, temporal uncertainty."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = "yyyy-MM-dd'T'HH:mm:ss"


def seconds_to_iso8601(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), _SECOND + "'Z'")


def seconds_to_local_iso8601(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), _SECOND)


def _millis(c: Column, suffix: str) -> Column:
    moment = F.timestamp_millis(c)
    return F.when(F.pmod(c, F.lit(1000)) == 0, F.date_format(moment, _SECOND + suffix)).otherwise(
        F.date_format(moment, _SECOND + ".SSS" + suffix)
    )


def millis_to_iso8601(c: Column) -> Column:
    """The fraction is printed only when it is not zero."""
    return _millis(c, "'Z'")


def millis_to_local_iso8601(c: Column) -> Column:
    return _millis(c, "")


# ---- bounds of a date literal (driver side) ---------------------------------------

_DATE = re.compile(r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$")


def day_bounds(text: str) -> tuple[date, date]:
    """First day of the stated precision and the first day after it."""
    match = _DATE.match(text.strip())
    if match is None:
        raise ValueError(f"not a year, month or day: {text!r}")
    year, month, day = (int(g) if g else None for g in match.groups())
    if month is None:
        return date(year, 1, 1), date(year + 1, 1, 1)
    if day is None:
        last = calendar.monthrange(year, month)[1]
        return date(year, month, 1), date(year, month, last) + timedelta(days=1)
    first = date(year, month, day)
    return first, first + timedelta(days=1)


def epoch_second(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())


def second_bounds(text: str) -> tuple[int, int]:
    """``day_bounds`` as epoch seconds; a date-time is one second wide."""
    if "T" in text:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        start = int(moment.timestamp())
        return start, start + 1
    low, high = day_bounds(text)
    return epoch_second(low), epoch_second(high)


def range_bounds(text: str) -> tuple[int | None, int | None]:
    """``a,b`` as [first second of a, first second after b); ``*`` leaves an end open."""
    low, high = (part.strip() for part in text.split(",", 1))
    start = None if low in ("*", "") else second_bounds(low)[0]
    end = None if high in ("*", "") else second_bounds(high)[1]
    return start, end


# ---- bounds of a date column, as SQL text shared with the registered functions ------

def lower_bound_sql(c: str) -> str:
    """First instant of a year, month or day given as text."""
    return f"try_to_timestamp(concat({c}, substr('0000-01-01', length({c}) + 1)), 'yyyy-MM-dd')"


def after_sql(c: str) -> str:
    """First instant after a year, month or day given as text."""
    start = lower_bound_sql(c)
    return (f"CAST(CASE length({c}) WHEN 4 THEN add_months({start}, 12) WHEN 7 THEN add_months({start}, 1)"
            f" ELSE date_add({start}, 1) END AS TIMESTAMP)")


def lower_bound(column: str) -> Column:
    return F.expr(f"unix_seconds({lower_bound_sql(column)})")


def upper_bound(column: str) -> Column:
    """Last second of a year, month or day given as text."""
    return F.expr(f"unix_seconds({after_sql(column)}) - 1")


def temporal_uncertainty_sql(event_date: str, event_time: str = "NULL") -> str:
    """Length in seconds of the interval a date, date-time or date range covers.

    Year, month and day precision count their whole length; a time narrows a
    single day to a minute or a second.  ``a/b`` runs from the start of a to the end of b.
    """
    first, last = f"substring_index({event_date}, '/', 1)", f"substring_index({event_date}, '/', -1)"

    def moment(c: str) -> str:
        return f"unix_seconds(try_to_timestamp(substr({c}, 1, 19)))"

    start = f"CASE WHEN length({first}) >= 16 THEN {moment(first)} ELSE unix_seconds({lower_bound_sql(first)}) END"
    end = (f"CASE WHEN length({last}) >= 19 THEN {moment(last)} + 1 WHEN length({last}) = 16 THEN {moment(last)} + 60"
           f" ELSE unix_seconds({after_sql(last)}) END")
    one_day = f"{event_date} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'"
    return (f"CASE WHEN {one_day} AND {event_time} RLIKE '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}' THEN 1L"
            f" WHEN {one_day} AND {event_time} RLIKE '^[0-9]{{1,2}}:[0-9]{{2}}' THEN 60L ELSE {end} - ({start}) END")


def temporal_uncertainty(event_date: str, event_time: str | None = None) -> Column:
    time = "CAST(NULL AS STRING)" if event_time is None else event_time
    return F.expr(temporal_uncertainty_sql(event_date, time))


# The day-level text forms accepted besides ISO, tried in this order.
DAY_FORMATS = ("yyyy-MM-dd", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "d/M/yyyy", "yyyyMMdd")
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM",
    "yyyy",
)


def parse_lenient(c: Column) -> Column:
    """First format that fits, as a timestamp; year 0 counts as year 1; else null."""
    text = F.regexp_replace(F.trim(c), "^0000", "0001")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS + DAY_FORMATS])
