import math

import pytest
from helpers import START

from skyloom.errors import ArgumentError, MissingError, UnitError
from skyloom.operators import gapfill, qc
from skyloom.sources import models, readers

RASTER = readers.Raster(50.0, 4.0, 1.0, 1.0)


def model():
    return models.Model("m", RASTER).add("temp", "t", "K").add_vector("wind", "u", "v", "km/h")


def test_table_of_kinds():
    m = model().add("temp", "t", "K").add("snow", "s", "kg/m**2", "g/m**2", "snow on the ground")
    assert m.table() == [("snow", "s", "kg/m**2", "g/m**2", "snow on the ground"), ("temp", "t", "K", "degree_Celsius", "2m - temperature"), ("wind", "u+v", "km/h", "meter/second", "")]
    assert m.bands() == ["s", "t", "u", "v"] and m.bands(["wind"]) == ["u", "v"] and m.bands([]) == []
    with pytest.raises(ArgumentError, match="already"):
        m.add("temp", "other", "K")
    with pytest.raises(ArgumentError, match="standard unit"):
        m.add("fog", "f", "m")
    for bad in ("hPa", "furlongs"):
        with pytest.raises(UnitError):
            m.add("humidity", "h", bad)
    for wrong in (lambda: m.add("humidity", "", "%"), lambda: m.add_vector("gust", "u", "u", "m/s"), lambda: models.Model("", RASTER)):
        with pytest.raises(ArgumentError):
            wrong()
    assert "humidity" not in m.kinds
    with pytest.raises(MissingError, match="fog, rain"):
        m.chosen(["rain", "temp", "fog"])


def test_sampling_by_kinds(spark):
    rows = [(4.0, "t", 273.15), (4.0, "u", 36.0), (4.0, "v", 0.0), (5.0, "u", 0.0), (5.0, "v", 0.0), (6.0, "u", 1.0), (6.0, "v", None), (4.0, "other", 1.0)]
    grid = spark.createDataFrame([(START, 50.0, lon, band, v) for lon, band, v in rows], "time timestamp, lat double, lon double, band string, value double")
    stations = spark.createDataFrame([("a", 50.0, 4.0), ("still", 50.0, 5.0), ("half", 50.0, 6.0), ("nowhere", None, 4.0)], "name string, lat double, lon double")
    day = START.strftime("%Y-%m-%d %H:%M:%S")
    got = {(r.name, r.obstype, r.modelvariable): r.value for r in model().sample(grid, stations, day, day).collect()}
    assert got.pop(("still", "wind_direction", "u+v")) is None and math.isclose(got.pop(("a", "wind_speed", "u+v")), 10.0)
    assert got == {("a", "temp", "t"): 0.0, ("a", "wind_direction", "u+v"): 90.0, ("still", "wind_speed", "u+v"): 0.0}
    assert {r.obstype for r in model().sample(grid, stations, day, day, ["temp"]).collect()} == {"temp"}
    assert model().sample(grid.limit(0), stations, day, day).count() == 0
    for where in (stations.drop("lat"), stations.where("name = 'nowhere'"), stations.limit(0)):
        with pytest.raises(MissingError):
            model().sample(grid, where, day, day)
    with pytest.raises(MissingError):
        model().sample(grid, stations, day, day, ["fog"])
    with pytest.raises(MissingError):
        models.Model("m", RASTER).sample(grid, stations, day, day)


def test_units_of_a_model_that_fills(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "name string, obstype string, datetime timestamp, value double, unit string")
    rows = make(("a", "temp", START, 273.15, "K"), ("b", "temp", START, 50.0, "degF"), ("c", "pressure", START, 1.0, "kPa"), ("d", "temp", START, None, "K"))
    got = gapfill.in_standard_units(rows)
    assert got.columns == ["name", "obstype", "datetime", "value"]
    assert {r.name: r.value and round(r.value, 9) for r in got.collect()} == {"a": 0.0, "b": 10.0, "c": 10.0, "d": None}
    assert gapfill.in_standard_units(rows.where("name = 'a'"), {"temp": "K"}).first().value == 273.15
    assert gapfill.in_standard_units(rows.limit(0)).count() == 0
    for bad in (("a", "temp", START, 1.0, "hPa"), ("a", "temp", START, 1.0, None), ("a", "temp", START, 1.0, "nonsense"), ("a", "fog", START, 1.0, "m")):
        with pytest.raises(UnitError):
            gapfill.in_standard_units(make(bad))
    gaps = spark.createDataFrame([("a", "temp", 0, START)], "name string, obstype string, gap_id long, datetime timestamp")
    with pytest.raises(UnitError):
        gapfill.fill_with_model("raw", gaps, None, make(("a", "temp", START, 1.0, "hPa")))
    assert gapfill.fill_with_model("raw", gaps, None, rows).first().value == 0.0


def test_outlier_view(spark):
    make = lambda label, *names: spark.createDataFrame([(n, "temp", START, 1.0, label) for n in names], "name string, obstype string, datetime timestamp, value double, label string")
    told = spark.createDataFrame([(n, "temp", START, 1.0, "y", d) for n, d in (("b", "why"), ("c", None), ("d", "so"))], "name string, obstype string, datetime timestamp, value double, label string, details string")
    out = {r.name: (r.label, r.details) for r in qc.outlier_view(make("x", "a", "b"), told, make("z", "d", "e")).collect()}
    assert out == {"a": ("x", ""), "b": ("x", ""), "c": ("y", ""), "d": ("y", "so"), "e": ("z", "")}
    assert qc.outlier_view(told.limit(0)).count() == 0
    with pytest.raises(ArgumentError):
        qc.outlier_view()
