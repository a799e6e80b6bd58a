"""Dates, timestamps and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_trunc(unit: str, x: str | Column, kind: str = "timestamp_ntz") -> Column:
    """Keeps the type of its argument."""
    return F.date_trunc(unit, _c(x)).cast(kind)


_INTERVAL = {"year": "years", "quarter": "months", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def date_add(unit: str, n: Column | int, x: str | Column) -> Column:
    """``n`` units later; the day is held within the month."""
    k = F.lit(n) if isinstance(n, int) else n
    if unit == "quarter":
        k = k * 3
    return _c(x) + F.make_interval(**{_INTERVAL[unit]: k})


def date_diff(unit: str, a: str | Column, b: str | Column) -> Column:
    """Whole units from a to b."""
    return F.timestamp_diff(unit.upper(), _c(a), _c(b))


def day_of_week(x: str | Column) -> Column:
    """Monday is 1, Sunday 7."""
    return F.weekday(_c(x)) + 1


def year_of_week(x: str | Column) -> Column:
    """The ISO year."""
    return F.extract(F.lit("YEAROFWEEK"), _c(x))


def millisecond(x: str | Column) -> Column:
    return (F.extract(F.lit("SECOND"), _c(x)) * 1000).cast("bigint") % 1000


def to_unixtime(x: str | Column) -> Column:
    """Seconds as a double; a timestamp without zone is taken as UTC."""
    return F.unix_micros(_c(x).cast("timestamp")) / F.lit(1e6)


def from_unixtime(x: str | Column) -> Column:
    return F.timestamp_seconds(_c(x))


#: MySQL format letters and Java's (fixed values).
_MYSQL = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss",
    "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%f": "SSSSSS", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%",
}


def mysql_pattern(pattern: str) -> str:
    """A MySQL date pattern as a Java one; plain letters are quoted."""
    out, at = "", 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[0] == "%":
            if two not in _MYSQL:
                raise ValueError(f"date format {two} is not supported")
            out, at = out + _MYSQL[two], at + 2
        else:
            out, at = out + (f"'{two[0]}'" if two[0].isalpha() else "''" if two[0] == "'" else two[0]), at + 1
    return out


def date_format(x: str | Column, pattern: str) -> Column:
    return F.date_format(_c(x), mysql_pattern(pattern))


def date_parse(x: str | Column, pattern: str) -> Column:
    return F.to_timestamp(_c(x), mysql_pattern(pattern)).cast("timestamp_ntz")


def to_iso8601(x: str | Column) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def at_timezone(x: str | Column, zone: str) -> Column:
    """The local time in ``zone`` of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(x))


def last_day_of_month(x: str | Column) -> Column:
    return F.last_day(_c(x))


#: Joda letters whose Java counterpart is another (fixed values).
_JODA = {"Y": "y", "x": "Y", "w": "w", "e": "e", "E": "E", "Z": "xx", "C": "G"}


def joda_pattern(pattern: str) -> str:
    """A Joda date pattern as a Java one; quoted text stays."""
    out, quoted = "", False
    for c in pattern:
        quoted ^= c == "'"
        out += c if quoted else _JODA.get(c, c)
    return out


def format_datetime(x: str | Column, pattern: str) -> Column:
    return F.date_format(_c(x), joda_pattern(pattern))


def parse_datetime(x: str | Column, pattern: str) -> Column:
    """An instant; a text without zone is taken in the session's."""
    return F.to_timestamp(_c(x), joda_pattern(pattern))


def from_iso8601_date(x: str | Column) -> Column:
    return F.to_date(_c(x), "yyyy-MM-dd")


def from_iso8601_timestamp(x: str | Column) -> Column:
    """An instant; a text without zone is taken in the session's."""
    return _c(x).cast("timestamp")


def with_timezone(x: str | Column, zone: str) -> Column:
    """The instant at which the clock in ``zone`` shows a timestamp without zone."""
    return F.to_utc_timestamp(_c(x).cast("timestamp"), zone)


def timezone_offset_minutes(x: str | Column, zone: str) -> Column:
    """Minutes that ``zone`` is ahead of UTC at an instant."""
    utc = _c(x).cast("timestamp")
    return ((F.unix_seconds(F.from_utc_timestamp(utc, zone)) - F.unix_seconds(utc)) / 60).cast("bigint")


def timezone_hour(x: str | Column, zone: str) -> Column:
    return F.call_function("div", timezone_offset_minutes(x, zone), F.lit(60).cast("bigint"))


def timezone_minute(x: str | Column, zone: str) -> Column:
    return timezone_offset_minutes(x, zone) % 60
