"""Instants as whole nanoseconds since 1970, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def nanos(ts: Column) -> Column:
    """A timestamp's nanoseconds; timestamps without a zone are UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 text with an offset; digits beyond nine are cut off, a 60th second runs into the next minute; null if malformed."""
    text = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"
    # One match tells the shape; what it holds stands at fixed places from either end.
    number = lambda at: F.substring(text, at, 2).try_cast("int")
    hour, minute, second = number(12), number(15), number(18)
    zulu = F.right(text, F.lit(1)).isin("Z", "z")
    digits = F.when(F.substring(text, 20, 1) == ".", F.substr(text, F.lit(21), F.least(F.length(text) - F.when(zulu, 21).otherwise(26), F.lit(9)))).otherwise("")
    fraction = F.rpad(digits, 9, "0").try_cast("bigint")
    offset = F.when(zulu, F.lit(0)).otherwise(F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1) * (number(-5) * 3600 + number(-2) * 60))
    seconds = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint") * 86_400 + hour * 3600 + minute * 60 + second - offset
    return F.when(F.regexp_like(text, F.lit(shape)) & (hour <= 23) & (minute <= 59) & (second <= 60), F.try_add(F.try_multiply(seconds, F.lit(SECOND)), fraction))


def format_rfc3339(ns: Column) -> Column:
    """Nine-digit RFC 3339 in UTC."""
    seconds = (ns - F.pmod(ns, F.lit(SECOND))) / SECOND
    return F.concat(F.date_format(F.timestamp_seconds(seconds.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(SECOND)).cast("string"), 9, "0"), F.lit("Z"))


def utc_date(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), ((ns - F.pmod(ns, F.lit(DAY))) / DAY).cast("int"))


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def minute_of_day(ns: Column) -> Column:
    return F.call_function("div", F.pmod(ns, F.lit(DAY)), F.lit(60 * SECOND)).cast("int")


def schedule_contains(days: Column, start: Column, end: Column, ns: Column) -> Column:
    """Whether an instant's weekday is in the bitmask (bit 0: Monday) and its minute in [start, end)."""
    minute = minute_of_day(ns)
    return (F.call_function("shiftright", days, iso_weekday(utc_date(ns)) - 1).bitwiseAND(F.lit(1)) == 1) & (minute >= start) & (minute < end)


def next_grid(ns: Column, anchor: int, step: int) -> Column:
    """The first boundary of a fixed grid after an instant."""
    return ns - F.pmod(ns - anchor, F.lit(step)) + step


def day_number(text: Column) -> Column:
    """1 for mon to 7 for sun, in any case; null for any other text."""
    at = F.array_position(F.array(*[F.lit(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")]), F.lower(F.trim(text)))
    return F.nullif(at, F.lit(0)).cast("int")


def hours_window(text: Column) -> Column:
    """struct<start, end> in minutes of HH:MM-HH:MM; null if malformed, empty or over midnight."""
    shape = r"^\s*(\d\d):(\d\d)\s*-\s*(\d\d):(\d\d)\s*$"
    a, b, c, d = (F.regexp_extract(text, shape, k).try_cast("int") for k in (1, 2, 3, 4))
    ok = (a <= 23) & (c <= 23) & (b <= 59) & (d <= 59) & (a * 60 + b < c * 60 + d)
    return F.when(ok, F.struct((a * 60 + b).alias("start"), (c * 60 + d).alias("end")))


def duration_seconds(text: Column) -> Column:
    """Seconds of a whole number with one unit, s, m, h or d; null for anything else."""
    shape = r"^\s*(\d+)([smhd])\s*$"
    unit = F.regexp_extract(text, shape, 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).cast("bigint")
    return F.try_multiply(F.regexp_extract(text, shape, 1).try_cast("bigint"), scale)
