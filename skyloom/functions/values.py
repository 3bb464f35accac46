"""Column expressions on values and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def number(text: Column) -> Column:
    """A text as a number, decimal comma or point; null for anything else and for NaN."""
    value = F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def no_nan(value: Column) -> Column:
    """NaN means missing: null from here on."""
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """``value`` within bounds; a null stays null."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def amplitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """Degrees clockwise from north of the vector (u, v), in [0, 360); null for the null vector."""
    return F.when((u != 0) | (v != 0), F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
