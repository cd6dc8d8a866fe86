"""Wall-clock times as milliseconds, without any time zone.

Times are calendar values counted as if in UTC. ``to_millis`` does not check ranges (31
February rolls on into March); what users type is checked by ``parse_ui_datetime``.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_EPOCH = dt.date(1970, 1, 1).toordinal()


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; month and day may be out of range."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = _div(y, 400)
    in_era = y - era * 400
    shifted = F.when(m > 2, m - 3).otherwise(m + 9)
    day = _div(153 * shifted + 2, 5) + d - 1
    return (era * 146_097 + in_era * 365 + _div(in_era, 4) - _div(in_era, 100) + day - 719_468).cast("long")


def to_millis(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, ms: Column) -> Column:
    return (civil_days(y, m, d) * DAY_MS + h * 3_600_000 + mi * 60_000 + s * 1000 + ms).cast("long")


def civil_from_days(days: Column) -> Column:
    """Date of a day number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def format_iso(millis: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSS``, whatever the session's time zone."""
    days = _div(millis, DAY_MS)
    rest = (millis - days * DAY_MS).cast("long")

    def two(x: Column, width: int = 2) -> Column:
        return F.lpad(x.cast("long").cast("string"), width, "0")

    clock = F.concat(two(_div(rest, 3_600_000)), F.lit(":"), two(_div(rest, 60_000) % 60), F.lit(":"), two(_div(rest, 1000) % 60), F.lit("."), two(rest % 1000, 3))
    return F.concat(F.date_format(civil_from_days(days), "yyyy-MM-dd"), F.lit("T"), clock)


def _part(text: Column, at: int, n: int) -> Column:
    return F.substring(text, at, n).try_cast("int")


def bound(values: list[Column], build: Callable[..., Column]) -> Column:
    """``build`` of integer values that are worked out once each, however often it uses them."""
    given = F.array(*[v.cast("int") for v in values])
    return F.element_at(F.transform(F.array(given), lambda a: build(*[a[i] for i in range(len(values))])), 1)


def log_places(text: Column) -> list[Column]:
    """Year to millisecond of the first 23 characters; digits by position, separators ignored."""
    return [_part(text, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2), (21, 3))]


def log_millis(text: Column) -> Column:
    """Millis of ``log_places``, without range checks."""
    return bound(log_places(text), to_millis)


MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"


def month_day_places(text: Column) -> list[Column]:
    """Year to millisecond of ``dd-MMM-yyyy HH:mm:ss.SSS``; a null month for an unknown one."""
    at = F.position(F.upper(F.substring(text, 4, 3)), F.lit(MONTHS))
    month = F.when((at > 0) & (at % 4 == 1), ((at - 1) / 4 + 1).cast("int"))
    return [_part(text, 8, 4), month, _part(text, 1, 2), _part(text, 13, 2), _part(text, 16, 2), _part(text, 19, 2), _part(text, 22, 3)]


def month_day_millis(text: Column) -> Column:
    """Millis of ``month_day_places``; null for an unknown month."""
    return bound(month_day_places(text), to_millis)


def millis_of(y: int, m: int, d: int, h: int = 0, mi: int = 0, s: int = 0, ms: int = 0) -> int:
    """``to_millis`` for a valid date."""
    return (dt.date(y, m, d).toordinal() - _EPOCH) * DAY_MS + h * 3_600_000 + mi * 60_000 + s * 1000 + ms


def iso(millis: int) -> str:
    """``format_iso`` of one value."""
    days, rest = divmod(millis, DAY_MS)
    return f"{dt.date.fromordinal(_EPOCH + days).isoformat()}T{rest // 3_600_000:02d}:{rest // 60_000 % 60:02d}:{rest // 1000 % 60:02d}.{rest % 1000:03d}"


def parse_ui_datetime(text: str | None) -> int | None:
    """Millis of a date, minute, second or millisecond that a user typed; None for nothing.

    Raises ValueError for other lengths, letters in place of digits, and times that do not
    exist. Separators may be any characters.
    """
    if text is None or not text.strip():
        return None
    t = text.strip().replace("T", " ")
    if len(t) not in (10, 16, 19, 23):
        raise ValueError(f"not a date and time: {text}")
    places = [(0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19), (20, 23)]
    digits = [t[a:b] if b <= len(t) else "0" for a, b in places]
    if not all(x.isascii() and x.isdigit() for x in digits):
        raise ValueError(f"not a date and time: {text}")
    try:
        dt.datetime(*(int(x) for x in digits[:6]))
    except ValueError as e:
        raise ValueError(f"no such date and time: {text}") from e
    return millis_of(*(int(x) for x in digits))


def ui_millis(text: Column) -> Column:
    """``parse_ui_datetime`` of a column; null where that raises."""
    t = F.regexp_replace(F.trim(text), "T", " ")
    size = F.length(t)
    parts = [F.when(size >= at + n - 1, _part(t, at, n)).otherwise(0) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2), (21, 3))]
    shape = t.rlike(r"^\d{4}.\d{2}.\d{2}(?:.\d{2}.\d{2}(?:.\d{2}(?:.\d{3})?)?)?$")
    y, m, d, h, mi, s, ms = parts
    real = F.try_make_timestamp_ntz(F.greatest(y, F.lit(1)), m, d, h, mi, F.when(s < 60, s).cast("decimal(8,6)")).isNotNull() & (y > 0)
    return F.when(shape & real, to_millis(y, m, d, h, mi, s, ms))


def whole_second(millis: int) -> int:
    return millis - millis % 1000


def around(millis: int, minutes: int) -> tuple[int, int]:
    """Bounds of a row's surroundings; its milliseconds are dropped first."""
    at = whole_second(millis)
    return at - minutes * 60_000, at + minutes * 60_000


def first_hours(low: int, high: int, hours: int) -> tuple[int, int]:
    """From the exact beginning of the data, within its bounds."""
    return low, min(high, low + hours * 3_600_000)


def last_hours(low: int, high: int, hours: int) -> tuple[int, int]:
    return max(low, high - hours * 3_600_000), high


_MINUTE = re.compile(r"\d{2}:\d{2}")


def minute_range(since_date: str | None, since_time: str | None, until_date: str | None, until_time: str | None) -> tuple[str | None, str | None]:
    """Typed dates and minutes as full bounds: ``HH:mm:00.000`` to ``HH:mm:59.999``."""
    for x in (since_time, until_time):
        if x and not _MINUTE.fullmatch(x):
            raise ValueError(f"not a time: {x}")
    since = f"{since_date} {since_time or '00:00'}:00.000" if since_date else None
    until = f"{until_date} {until_time or '23:59'}:59.999" if until_date else None
    return since, until
