"""Column expressions on time, in microseconds since the epoch where a number is meant."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError

SECOND = 1_000_000
# The spans to which a time is rounded, largest first, in seconds.
ROUND_TO = (86400, 3600, 1800, 600, 300, 60, 30)
_UNITS = {"us": 1, "ms": 1000, "s": SECOND, "sec": SECOND, "min": 60 * SECOND, "t": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND}


def micros(span: str | int) -> int:
    """A span such as ``"90s"``, ``"5min"``, ``"1h30min"`` or ``"h"`` in microseconds; an integer is taken as microseconds."""
    if isinstance(span, int):
        return span
    text = span.strip().lower().replace(" ", "")
    parts = re.findall(r"(\d+(?:\.\d+)?)?([a-z]+)", text)
    if not parts or "".join(a + b for a, b in parts) != text or any(b not in _UNITS for _, b in parts):
        raise ArgumentError(f"not a span of time: {span!r}")
    return sum(round(float(a or 1) * _UNITS[b]) for a, b in parts)


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def round_half_even(us: Column, step: int) -> Column:
    """The multiple of ``step`` nearest to ``us``; of two equally near, the even one."""
    rest = F.pmod(us, F.lit(step))
    low = us - rest
    up = (rest * 2 > step) | ((rest * 2 == step) & (F.pmod((low / step).cast("long"), F.lit(2)) == 1))
    return low + F.when(up, F.lit(step)).otherwise(F.lit(0))


def simplify(us: Column, tolerance: int, zero_protected: bool = False) -> Column:
    """The roundest time closer to ``us`` than ``tolerance``, or ``us`` itself; with ``zero_protected`` a span never becomes 0."""
    tries = []
    for seconds in ROUND_TO:
        step = seconds * SECOND
        near = round_half_even(us, step)
        if zero_protected:
            near = F.when(near == 0, F.lit(step)).otherwise(near)
        tries.append(F.when(F.abs(us - near) < tolerance, near))
    return F.coalesce(*tries, us)


def season(day_of_year: Column) -> Column:
    """Season by fixed days of the year: spring from 62, summer from 154, autumn from 246, winter from 337 on and up to 61."""
    return (
        F.when(day_of_year.isNull(), F.lit(None))
        .when((day_of_year > 336) | (day_of_year <= 61), "winter")
        .when(day_of_year <= 153, "spring")
        .when(day_of_year <= 245, "summer")
        .otherwise("autumn")
    )


def derivatives(ts: Column) -> dict[str, Column]:
    """The parts of a time by which records are grouped."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "day_of_year": F.dayofyear(ts),
        "season": season(F.dayofyear(ts)),
    }
