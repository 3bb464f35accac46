"""Unit algebra and conditions, against values worked out by hand and data frames' own answers."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError, UnitError
from skyloom.functions import units
from skyloom.functions.conditions import condition


@pytest.mark.parametrize(
    ("unit", "to", "want"),
    [
        ("mm/h", "m/s", 1 / 3.6e6), ("kJ/m**2", "J/cm^2", 0.1), ("inHg", "hPa", 33.86388640341), ("kg*m**-2", "g/cm²", 0.1), ("kW*hour", "MJ", 3.6),
        ("W m-2", "kilojoule / meter**2 / hour", 3.6), ("m s⁻¹", "km/h", 3.6), ("millimeter/meter**2", "mm/m²", 1), ("1/min", "Hz", 1 / 60), ("10 m", "km", 0.01),
        ("percent", "dimensionless", 0.01), ("degree", "rad", math.pi / 180), ("(kg*m)/(s**2)", "newton", 1), ("km**0.5 * km**1.5", "m**2", 1e6), ("feet", "inches", 12),
        ("KM/H", "m/s", 1 / 3.6), ("hpa", "pascal", 100), ("µg/m³", "mg/m3", 1e-3), ("J/kg/K", "cal/g/degC", 1 / 4184), ("meter per second", "knots", 3600 / 1852),
    ],
)
def test_products_of_powers(spark, unit, to, want):
    assert spark.range(1).select(units.convert(F.lit(1.0), unit, to)).first()[0] == pytest.approx(want)
    assert units.are_compatible(unit, to) and units.are_compatible(to, unit)


def test_scales_keep_their_offset_alone(spark):
    one = lambda *a: spark.range(1).select(units.convert(F.lit(10.0), *a)).first()[0]
    assert one("degC", "K") == pytest.approx(283.15) and one("°F", "°C") == pytest.approx(-110 / 9) and one("K", "degR") == pytest.approx(18)
    assert one("degC/km", "K/m") == pytest.approx(0.01)  # a lapse rate is a difference


def test_names_of_units():
    assert units.canonical("mm / h") == "millimeter/hour" and units.canonical("W/m2") == "watt/meter**2" and units.canonical("hPa") == "hectopascal"
    assert units.canonical("kg*m**-2") == "kilogram/meter**2" and units.canonical("s**-1") == "1/second" and units.canonical("%") == "percent"
    assert {"knot", "mile_per_hour", "meter/second"} <= set(units.compatible("km/h")) and "kelvin" not in units.compatible("km/h")


@pytest.mark.parametrize("bad", ["furlong", "m/", "m**", "(m", "m)", "kkm", "millifoot", "m & s", "**2"])
def test_what_is_no_unit(bad):
    assert not units.is_known(bad)
    with pytest.raises(UnitError):
        units.parse(bad)


def test_units_of_other_dimensions():
    for unit, to in (("mm", "mm/m²"), ("hPa", "m/s"), ("K", "percent")):
        with pytest.raises(UnitError, match="dimensions differ"):
            units.convert(F.lit(1.0), unit, to)


FRAME = pd.DataFrame(
    {
        "a": [1.0, 2.0, 3.5, None, 6.0, -4.0], "b": [2, 0, 3, 5, 6, 7], "s": ["winter", "say \"hi\"", None, "x & y", "autumn", "a | b"],
        "ok": [True, False, True, True, False, False], "odd name": [1, 2, 3, 4, 5, 6], "t": pd.to_datetime(["2024-01-0%d" % i for i in range(1, 7)]),
    }
)
QUERIES = [
    "1 < a <= 5", "a // 2 == 1", "a ** 2 > 10", "a + b * 2 > 10 & ok", "~ok | a < 0", "not ok and a > 1", "a != 2", "s != 'winter'", "s in ['winter', \"autumn\"]",
    "s not in ['winter']", "s == 'x & y' | s == 'a | b'", "s == \"say \\\"hi\\\"\"", "`odd name` > 3 & b < 7", "~(a > 2)", "a % 3 == 0", "-a > 3", "a / b > 1", "b == [2, 6]",
    "(a > 1) & (b > 2) | ok", "a > 1 & b > 2 | ok", "1 < 2 < a", "sqrt(b) > 2", "a.isna()", "a.notnull() & b == 0", "t > '2024-01-03' & t <= \"2024-01-05\"", "ok == True", "s == 1", "b // 4 * 4 == b",
]


@pytest.mark.parametrize("text", QUERIES)
def test_conditions_are_those_of_data_frames(spark, text):
    want = FRAME.query(text.replace("&&", "&"), engine="python")["odd name"].tolist()
    rows = [tuple(None if v is pd.NaT or v is None or v != v else v for v in r) for r in FRAME.itertuples(index=False)]
    df = spark.createDataFrame([(*r[:5], r[5].to_pydatetime()) for r in rows], "a double, b int, s string, ok boolean, `odd name` int, t timestamp")
    assert sorted(r["odd name"] for r in df.where(condition(text, df)).collect()) == want


@pytest.mark.parametrize("bad", ["a >", "winter == s2", "a > 'x'", "a", "__import__('os')", "reflect('a', 'b')", "a if ok else b", "[x for x in s]", "s.upper() == 'A'", "a in b", "ok + 'x'", "lambda: 1", "a := 1", ""])
def test_what_is_no_condition(spark, bad):
    df = spark.createDataFrame([(1.0, 2, "x", True)], "a double, b int, s string, ok boolean")
    with pytest.raises(ArgumentError):
        condition(bad, df)
