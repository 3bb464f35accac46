"""Files in order, rows that can't be used, rasters sampled at stations, and aggregates of the user's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError, UnitError
from skyloom.operators import analysis
from skyloom.sources import readers
from skyloom.sources.template import Template

LONG = Template.build(name_column="station", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": ("t", "degC", None)})


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return f"{folder}/*.csv"


def test_first_of_a_repeated_stamp_is_that_of_the_first_file(spark, tmp_path):
    rows = [f"x,2024-01-01 {h:02d}:00:00,{h}" for h in range(24)]
    small = "station,when,t\nx,2024-01-01 05:00:00,100\n"
    path = write(tmp_path, a=small, b="station,when,t\n" + "\n".join(rows * 40) + "\n")
    out = readers.import_data(spark, LONG, path)["outliers"]
    assert {r.datetime.hour: r.value for r in out.collect()} == {h: 100.0 if h == 5 else float(h) for h in range(24)}


def test_files_of_other_columns_meet_by_name(spark, tmp_path):
    path = write(tmp_path, a="station,when,t\nx,2024-01-01 00:00:00,1\n", b="t;extra;when;station\n2;e;2024-01-01 01:00:00;x\n3;e;2024-01-01 02:00:00;y\n", c="")
    df = readers.read(spark, path)
    assert {"station", "when", "t", "extra"} <= set(df.columns)
    got = sorted((r.name, r.datetime.hour, r.value) for r in readers.observations(df, LONG).collect())
    assert got == [("x", 0, 1.0), ("x", 1, 2.0), ("y", 2, 3.0)]


def test_order_of_frames_without_files(spark):
    df = spark.createDataFrame([("x", "2024-01-01 00:00:00", str(i)) for i in range(5)], "station string, when string, t string").coalesce(1)
    assert [r.value for r in readers.observations(df, LONG).orderBy("file_order").collect()] == [0, 1, 2, 3, 4]


def test_rows_that_do_not_fit_are_kept_apart(spark, tmp_path):
    path = write(tmp_path, a="station,when,t\nx,2024-01-01 00:00:00,1\nx,nonsense,2\n,2024-01-01 01:00:00,3\nx,2024-01-01 02:00:00,no number\nx,2024-01-01 03:00:00,4\n")
    out = readers.import_data(spark, LONG, path)
    bad = sorted((r.reason, r.text) for r in out["rejected"].collect())
    assert bad == [("no name", '{"when":"2024-01-01 01:00:00","t":"3"}'), ("no stamp", '{"station":"x","when":"nonsense","t":"2"}')]
    assert all(r.file.endswith("a.csv") for r in out["rejected"].collect()) and out["obs"].count() == 2


def test_rasters_are_sampled_in_the_cell_that_holds_a_place(spark):
    raster = readers.Raster(50.0, 4.0, 0.5, 0.25, "3h")
    grid = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", 50.0 + i * 0.5, 4.0 + j * 0.25, b, 100.0 * h + 10 * i + j) for h in (0, 3, 6, 9) for i in range(3) for j in range(3) for b in ("t", "p")], "time string, lat double, lon double, band string, value double").withColumn("time", F.col("time").cast("timestamp")).withColumn("day", F.to_date("time"))
    stations = spark.createDataFrame([("a", 50.2, 4.1), ("b", 50.3, 4.13), ("edge", 50.25, 4.0), ("outside", 49.7, 4.0), ("nowhere", None, 4.0)], "name string, lat double, lon double")
    got = readers.sample_model(grid, raster, stations, "m", {"temp": ("t", "degC")}, "2024-01-01 03:00:00", "2024-01-01 03:00:00", "day")
    assert sorted((r.name, r.datetime.hour, r.value) for r in got.collect()) == [("a", 3, 300.0), ("b", 3, 311.0), ("edge", 3, 310.0)]
    assert readers.sample_model(grid, raster, stations, "m", {"temp": ("t", "degC")}, "2024-01-01 00:00:00", "2024-01-01 06:00:00").count() == 9
    with pytest.raises(UnitError):
        readers.sample_model(grid, raster, stations, "m", {"temp": ("t", "furlong")}, "2024-01-01", "2024-01-02")


def test_aggregates_of_the_users_own(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", None), ("b", 2.0), (None, 9.0), ("c", None)], "g string, temp double")
    of = lambda method, **options: {r.g: r.temp for r in analysis.aggregate(df, "temp", ["g"], method, **options).collect()}
    assert of(lambda v: v.max() - v.min() if len(v) else None) == {"a": 4.0, "b": 0.0, "c": None}
    assert of(np.nanmean) == of("mean") == {"a": 3.0, "b": 2.0, "c": None} and of(np.median) == of(0.5)
    assert of(0.25) == {"a": 2.0, "b": 2.0, "c": None}
    for bad in ("no such", 1.5, 3, None):
        with pytest.raises(ArgumentError):
            of(bad)
    with pytest.raises(ArgumentError, match="more than 1 values"):
        of(lambda v: 0.0, group_rows=1)
    assert "AggregateInPandas" not in analysis.aggregate(df, "temp", ["g"], np.nanmean)._jdf.queryExecution().toString()
