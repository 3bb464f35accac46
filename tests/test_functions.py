import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError, SettingsError, UnitError
from skyloom.functions import time as T
from skyloom.functions import units
from skyloom.functions import values as V
from skyloom.settings import Settings


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, us", [("90s", 90_000_000), ("5min", 300_000_000), ("h", 3_600_000_000), ("1h30min", 5_400_000_000), ("1d", 86_400_000_000), (7, 7)])
def test_micros(text, us):
    assert T.micros(text) == us


def test_micros_rejects():
    for bad in ("", "5 parsecs", "min5"):
        with pytest.raises(ArgumentError):
            T.micros(bad)


def test_round_half_even(spark):
    step = 60_000_000
    for k, want in ((0.5, 0), (1.5, 2), (2.5, 2), (1.4, 1), (1.6, 2)):
        assert one(spark, T.round_half_even(F.lit(int(k * step)), step)) == want * step


def test_simplify(spark):
    base = 1_704_067_200_000_000  # midnight
    minute = 60_000_000
    for us, tolerance, want in ((base + 3 * minute, 5 * minute, base), (base + 5 * minute, 5 * minute, base + 5 * minute), (base + 61 * minute, 2 * minute, base + 60 * minute), (base + 7_000_001, 1_000_000, base + 7_000_001)):
        assert one(spark, T.simplify(F.lit(us), tolerance)) == want
    assert one(spark, T.simplify(F.lit(20_000_000), 120_000_000, zero_protected=True)) > 0


@pytest.mark.parametrize("day, season", [(1, "winter"), (61, "winter"), (62, "spring"), (153, "spring"), (154, "summer"), (245, "summer"), (246, "autumn"), (336, "autumn"), (337, "winter"), (366, "winter")])
def test_season(spark, day, season):
    assert one(spark, T.season(F.lit(day))) == season


def test_derivatives(spark):
    row = spark.createDataFrame([(dt.datetime(2020, 6, 1, 13, 5, 9),)], ["t"]).select(*[c.alias(n) for n, c in T.derivatives(F.col("t")).items()]).first()
    assert row.asDict() == {"year": 2020, "month": 6, "hour": 13, "minute": 5, "second": 9, "day_of_year": 153, "season": "spring"}


def test_units(spark):
    for value, a, b, want in ((300.0, "K", "celsius", 26.85), (212.0, "degF", "degC", 100.0), (101325.0, "Pa", "hPa", 1013.25), (36.0, "km/h", "m/s", 10.0), (0.5, "dimensionless", "%", 50.0)):
        assert one(spark, units.convert(F.lit(value), a, b)) == pytest.approx(want)
    assert "kelvin" in units.compatible("degC") and units.is_known("knot") and not units.is_known("furlong")
    with pytest.raises(UnitError):
        units.convert(F.lit(1.0), "K", "hPa")
    with pytest.raises(UnitError):
        units.canonical("furlong")


def test_numbers(spark):
    rows = spark.createDataFrame([("1,5",), ("abc",), (" 2.25 ",), (None,), ("",), ("NaN",), ("1e3",)], "t string").select(V.number(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [1.5, None, 2.25, None, None, None, 1000.0]


def test_vectors(spark):
    for u, v, want in ((0.0, 1.0, 0), (1.0, 0.0, 90), (0.0, -1.0, 180), (-1.0, 0.0, 270)):
        assert one(spark, V.direction(F.lit(u), F.lit(v))) == pytest.approx(want)
    assert one(spark, V.direction(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, V.amplitude(F.lit(3.0), F.lit(4.0))) == 5
    assert one(spark, V.clip(F.lit(None).cast("double"), 0, 1)) is None and one(spark, V.clip(F.lit(7.0), 0, 1)) == 1


def test_haversine(spark):
    got = one(spark, V.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert got == pytest.approx(math.pi / 2 * V.EARTH_RADIUS_M)
    assert one(spark, V.haversine(F.lit(10.0), F.lit(179.99), F.lit(10.0), F.lit(-179.99))) < 3000


def test_settings():
    s = Settings()
    s.set("quality.repetitions.max_n", 9)
    assert s.get("quality.repetitions.max_n") == 9 and s.to_dict()["quality"]["repetitions"] == {"max_n": 9}
    s.reset("quality.repetitions")
    assert s.get("quality.repetitions.max_n") == 5
    for bad in ("quality.nothing", "nothing"):
        with pytest.raises(SettingsError):
            s.get(bad)
    with pytest.raises(SettingsError):
        s.set("quality", 1)
