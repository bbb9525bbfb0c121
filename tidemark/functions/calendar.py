"""Event time as epoch milliseconds (UTC) and what is derived from it; free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def ntz_to_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def any_to_ms(x: Column) -> Column:
    """Seconds, milliseconds or microseconds told apart by magnitude; too small or large is NULL."""
    a = F.abs(x)
    return F.when((a >= 1e8) & (a < 1e11), x * 1000).when((a >= 1e11) & (a < 1e14), x).when((a >= 1e14) & (a < 1e17), F.floor(x / 1000)).cast("long")


def floor_to(ms: Column, step: int) -> Column:
    return (F.floor(ms / step) * step).cast("long")


def day_number(ms: Column) -> Column:
    return F.floor(ms / DAY).cast("long")


def to_date(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(ms).cast("int"))


def iso(ms: Column) -> Column:
    """2024-01-02T03:04:05Z, without touching the session time zone."""
    second = F.floor(F.pmod(ms, F.lit(DAY)) / 1000)
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(second / 3600), F.floor(F.pmod(second, F.lit(3600)) / 60), F.pmod(second, F.lit(60)))
    return F.concat(F.date_format(to_date(ms), "yyyy-MM-dd"), clock)


def minute_of_day(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY)) / MINUTE).cast("int")


def hour_of_day(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY)) / HOUR).cast("int")


def weekday(ms: Column) -> Column:
    """Monday is 0; 1970-01-01 was a Thursday."""
    return F.pmod(day_number(ms) + 3, F.lit(7)).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def session_bucket(ms: Column) -> Column:
    """Four UTC sessions of six hours."""
    h = hour_of_day(ms)
    return F.when(h < 6, "asia").when(h < 12, "europe").when(h < 18, "us_open").otherwise("us_late")


def is_weekend(ms: Column) -> Column:
    return weekday(ms) >= 5


def local_minute(ms: Column, zone: str = "America/New_York") -> Column:
    """Minute of the day on the clock of a zone, daylight saving included."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))
    return (F.hour(local) * 60 + F.minute(local)).cast("int")


def in_session(ms: Column, opens: int = 570, closes: int = 960, zone: str = "America/New_York") -> Column:
    """Cash session on weekdays, [opens, closes) in local minutes; the weekday is the local one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))
    m = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & (m >= opens) & (m < closes)
