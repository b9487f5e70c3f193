"""Exact integer arithmetic on columns: rounding rules, clamps, closed intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
PPM = 1_000_000


def big(x: Column | str | int) -> Column:
    """x as a wide integer, for products beyond 64 bits."""
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast(WIDE)


def round_div(n: Column, d: int | Column) -> Column:
    """n / d rounded to the nearest integer, ties away from zero; d > 0."""
    d = F.lit(d) if isinstance(d, int) else d
    half = F.expr("1") * (2 * F.abs(n) + d)
    return (F.signum(n.cast("double")).cast("bigint") * _div(half, 2 * d)).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b)


def trunc_div(n: Column, d: int | Column) -> Column:
    """n / d without its fraction."""
    return _div(n, F.lit(d) if isinstance(d, int) else d)


def floor_div(n: Column, d: int | Column) -> Column:
    """The greatest integer not above n / d."""
    d = F.lit(d) if isinstance(d, int) else d
    return _div(n - F.pmod(n, d), d)


def ceil_div(n: Column, d: int | Column) -> Column:
    """The least integer not below n / d."""
    return -floor_div(-n, d)


def clamp(x: Column, lo: int | Column, hi: int | Column) -> Column:
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return F.greatest(lo, F.least(hi, x))


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def interval_sub(a: Column, b: Column) -> Column:
    return interval(a["lo"] - b["hi"], a["hi"] - b["lo"])


def interval_add(a: Column, b: Column) -> Column:
    return interval(a["lo"] + b["lo"], a["hi"] + b["hi"])


def interval_mul(a: Column, b: Column) -> Column:
    """The hull of the four corners' products."""
    corners = [x * y for x in (a["lo"], a["hi"]) for y in (b["lo"], b["hi"])]
    return interval(F.least(*corners), F.greatest(*corners))


def share_ppm(n: Column, d: Column) -> Column:
    """n / d in millionths, rounded half up; null where d is 0."""
    return F.when(d != 0, round_div(n * PPM, d))


def basis_points(value: Column, base: Column) -> Column:
    """How far value lies from base, in hundredths of a percent of |base|, rounded half away from zero; null where base is 0."""
    return F.when(base != 0, round_div((value - base) * 10_000, F.abs(base)))


def compact_count(n: Column) -> Column:
    """1234567 as 1.2M: one decimal, cut off, from a thousand up."""
    tenth = lambda unit: F.concat(trunc_div(n, unit).cast("string"), F.lit("."), F.pmod(trunc_div(n, unit // 10), F.lit(10)).cast("string"))
    return F.when(n >= 1_000_000_000, F.concat(tenth(1_000_000_000), F.lit("B"))).when(n >= 1_000_000, F.concat(tenth(1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(tenth(1_000), F.lit("k"))).otherwise(n.cast("string"))
