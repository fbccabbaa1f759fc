"""Scalar helpers with the host database's semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of truncation.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero, as integers divide in the host."""
    return F.call_function("div", a, b)


def round_to_int(x: Column) -> Column:
    """A cast of a number to integer rounds there, where Spark's truncates."""
    return F.round(x).cast("int")


def date_trunc_ntz(unit: str, x: Column) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is not one of {', '.join(UNITS)}")
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def array_get(xs: list, i: Column) -> Column:
    """ARRAY[...][i]: 1-based, null outside."""
    return F.try_element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int"))


def add_days(d: Column, n: Column | int) -> Column:
    """date + integer."""
    return F.date_add(d, n if isinstance(n, Column) else F.lit(n))


def add_seconds(t: Column, n: Column) -> Column:
    """timestamp + n * interval '1 second'."""
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)
