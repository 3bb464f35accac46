"""Sources, sinks, merging, analysis and land cover."""

import datetime as dt
import json

import pytest
from helpers import at, series
from pyspark.sql import functions as F

from skyloom.errors import AmbiguousError, ArgumentError, MissingError, TemplateError
from skyloom.operators import analysis, ingest, landcover, merge
from skyloom.sources import readers, sinks
from skyloom.sources.template import Template

LONG = {
    "data_related": {
        "structure": "long",
        "timestamp": {"date_column": "date", "date_fmt": "%Y-%m-%d", "time_column": "time", "time_fmt": "%H:%M:%S", "timezone": "Europe/Berlin"},
        "name_column": "station",
        "obstype_mapping": [{"tlk_obstype": "temp", "columnname": "t", "unit": "degK", "description": "x"}, {"tlk_obstype": "wind_speed", "columnname": "w", "unit": "km/h", "description": "y"}],
    },
    "metadata_related": {"name_column": "station", "lat_column": "lat", "lon_column": "lon", "columns_to_include": ["town"]},
    "single_station_name": "dummy",
}


def test_long_import(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(LONG))
    (tmp_path / "d.csv").write_text(
        "station;date;time;t;w;lat\n"
        "a;2024-06-01;12:00:00;300;36\n"
        "a;2024-06-01;12:10:00;bad;36\n"
        "a;2024-06-01;12:20:00;301,5;\n"
        "a;2024-06-01;12:20:00;302;18\n"
        "b;2024-06-01;12:00:00;300;36\n"
        ";2024-06-01;12:00:00;300;36\n"
        "a;2024-03-31;02:30:00;280;1\n"
    )
    (tmp_path / "m.csv").write_text("station,lat,lon,town,other\na,50.5,4.1,X,1\na,1,1,Y,2\n")
    t = Template.read(str(tmp_path / "t.json"))
    assert Template.from_dict(t.to_dict()) == t
    out = readers.import_data(spark, t, str(tmp_path / "d.csv"), str(tmp_path / "m.csv"))
    temps = {r.datetime: r.value for r in out["obs"].where("obstype = 'temp'").collect()}
    assert temps == {dt.datetime(2024, 6, 1, 10): pytest.approx(26.85), dt.datetime(2024, 6, 1, 10, 20): None}
    assert [(r.obstype, r.value) for r in out["outliers"].orderBy("obstype").collect()] == [("temp", pytest.approx(28.35)), ("wind_speed", None)]
    assert [(r.name, r.lat, r.extra) for r in out["stations"].collect()] == [("a", 50.5, {"town": "X"})]


def test_wide_and_single(spark, tmp_path):
    (tmp_path / "w.csv").write_text("when,st 1,st-2\n2024-01-01 00:00:00,1,2\n2024-01-01 00:10:00,,4\n2024-01-01 00:20:00,5,x\n")
    wide = Template.build(structure="wide", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": (None, "degC", None)})
    rows = readers.observations(readers.read(spark, str(tmp_path / "w.csv")), wide)
    assert sorted((r.name, r.value) for r in rows.collect() if r.value is not None) == [("st 1", 1), ("st 1", 5), ("st-2", 2), ("st-2", 4)]
    one = Template.build(structure="single_station", single_name="solo", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": ("st 1", "degC", None)})
    (tmp_path / "m.csv").write_text("name,lat\nreal,1\n")
    meta = Template.build(structure="single_station", datetime_column="when", meta_name_column="name", meta_lat_column="lat", obstypes=one.obstypes)
    data = readers.import_data(spark, meta, str(tmp_path / "w.csv"), str(tmp_path / "m.csv"))
    assert {r.name for r in data["obs"].collect()} == {"real"}
    assert {r.name for r in readers.observations(readers.read(spark, str(tmp_path / "w.csv")), one).collect()} == {"solo"}


def test_templates_are_checked(spark, tmp_path):
    for bad in ({"structure": "round"}, {"datetime_column": None}, {"timezone": "Mars/Base"}, {"name_column": None}, {"obstypes": {"temp": ("t", "furlong", None)}}):
        with pytest.raises(TemplateError):
            Template.build(**({"datetime_column": "d", "name_column": "n"} | bad))
    t = Template.build(datetime_column="d", name_column="n", obstypes={"temp": ("t", None, None)})
    with pytest.raises(TemplateError):
        readers.observations(spark.createDataFrame([("x",)], "n string"), t)


def test_csv_separators(spark, tmp_path):
    for i, sep in enumerate(",;\t| "):
        (tmp_path / f"{i}.csv").write_text(f"a{sep}b\n1{sep}2\n")
        assert readers.csv(spark, str(tmp_path / f"{i}.csv")).columns == ["a", "b"]
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "o.csv").write_text("one\n1\n")
    for bad in ("e.csv", "o.csv", "x.txt"):
        with pytest.raises(ArgumentError):
            readers.read(spark, str(tmp_path / bad))


def test_model_series(spark):
    raw = spark.createDataFrame([("a", "20240101060000", "300", "3", "4", "1")], "name string, datetime string, temperature_2m string, u string, v string, junk string")
    out = {r.obstype: r.value for r in readers.model_series(raw, "era", {"temp": ("temperature_2m", "K"), "pressure": ("missing", "Pa")}, ("u", "v")).collect()}
    assert out == {"temp": pytest.approx(26.85), "wind_speed": 5, "wind_direction": pytest.approx(36.8699)}


def test_sinks(spark, tmp_path):
    obs = series(spark, [(0, 1), (10, None)])
    sinks.to_parquet(obs, str(tmp_path / "x"))
    sinks.to_csv(obs, str(tmp_path / "y"))
    with pytest.raises(Exception, match="exists"):
        sinks.to_parquet(obs, str(tmp_path / "x.parquet"))
    sinks.to_parquet(obs, str(tmp_path / "x"), overwrite=True)
    sinks.save({"obs": obs}, str(tmp_path / "set"))
    assert merge.same_rows(sinks.load(spark, str(tmp_path / "set"))["obs"], obs)
    stacked = sinks.stacked(obs.withColumn("label", F.lit("gap")), obs)
    assert sorted((r.kind, r.value) for r in stacked.collect() if r.datetime == at(0)) == [("label", 11), ("model", 1), ("obs", 1)]


def test_merging(spark):
    a, b = series(spark, [(0, 1), (10, None)]), series(spark, [(10, 5), (0, 9), (20, 7)])
    key = ["name", "obstype", "datetime"]
    assert [r.value for r in merge.combine_first(a, b, key, ["value"]).orderBy("datetime").collect()] == [1, 5, 7]
    assert merge.only_left(b, a, key).count() == 1 and merge.shared(b, a, key).count() == 2
    with pytest.raises(ArgumentError):
        merge.upsert(a, b, key)
    assert merge.upsert(a, b, key, force=True).count() == 3
    with pytest.raises(ArgumentError):
        merge.require_unique(a.union(a), key)
    with pytest.raises(MissingError):
        merge.by_id(a, "name", "zz")
    schema = "name string, lat double, lon double, altitude double, extra map<string,string>"
    x = spark.createDataFrame([("a", 1.0, None, None, {"k": "1", "l": "1"})], schema)
    y = spark.createDataFrame([("a", 1.0, None, 5.0, {"k": "2"}), ("b", 0.0, 0.0, None, None)], schema)
    out = {r.name: r for r in merge.merge_sites(x, y).collect()}
    assert out["a"].altitude == 5 and out["a"].extra == {"l": "1", "k": "2"} and "b" in out
    with pytest.raises(ArgumentError):
        merge.merge_sites(x, y.withColumn("lat", F.lit(9.0)))
    assert {r.name for r in merge.rename_stations(y, {"a": "c", "b": "a", "q": "r"}).collect()} == {"c", "b"}
    assert merge.join_texts("x", "y") == "x +++ y" and merge.join_texts("x", "x") == "x" and merge.join_texts(None, "y") == "y"
    new = spark.createDataFrame([("a", 3.0)], "name string, altitude double")
    assert {r.name: r.altitude for r in merge.update_dimension(y, new, "altitude", F.lit(0.0)).collect()} == {"a": 3, "b": 0}


def test_analysis(spark):
    obs = series(spark, [(60 * i, i) for i in range(48)]).union(series(spark, [(60 * i, 2 * i) for i in range(24)], "b"))
    wide = analysis.wide(obs, ["temp"])
    where = spark.createDataFrame([("a", "x"), ("b", None)], "name string, kind string")
    assert analysis.filter_records(wide, 'temp >= 4 & season=="winter" & ~(hour > 5)').count() == 12
    assert analysis.filter_metadata(wide, where, "kind == 'x' | kind == 'a == b'").count() == 48
    assert analysis.subset_period(obs, at(0), at(60)).count() == 4
    assert [tuple(r) for r in analysis.aggregate(wide, "temp", ["kind"], "max", where).collect()] == [("x", 47)]
    cycle = {(r.name, r.hour): r.value for r in analysis.diurnal_cycle(wide, "temp").collect()}
    assert cycle["a", 1] == 13 and cycle["b", 1] == 2
    with pytest.raises(MissingError):
        analysis.diurnal_cycle_against(wide, "temp", "absent")
    against = {(r.name, r.hour): r.value for r in analysis.diurnal_cycle_against(wide, "temp", "b").collect()}
    assert against["a", 3] == -3 and against["b", 3] == 0
    for bad in (lambda: analysis.aggregate(wide, "temp", ["kind"], "no"), lambda: analysis.subset_stations(obs, ["a"]), lambda: analysis.diurnal_cycle(wide, "temp", "hour")):
        with pytest.raises(ArgumentError):
            bad()
    with pytest.raises(MissingError):
        analysis.aggregate(wide, "temp", ["nothing"])
    with pytest.raises(MissingError):
        analysis.one_series(obs, "q")
    assert analysis.one_series(obs, "a", "temp").count() == 48 and analysis.having(obs, "temp").count() == 72
    model = obs.withColumn("modelname", F.when(F.col("name") == "a", "m2").otherwise("m1")).withColumn("modelvariable", F.lit("v"))
    assert {r.name for r in analysis.select_model(model, "temp").collect()} == {"b"}
    with pytest.raises(AmbiguousError):
        analysis.select_model(model, "temp", strict=True)


def test_landcover(spark):
    pixels = spark.createDataFrame([("a", 100, c) for c in (10, 10, 50, 80)] + [("a", 100, None)], "name string, radius int, class int")
    assert {r["class"]: r.fraction for r in landcover.fractions(pixels).collect()} == {c: 0.0 for c in landcover.LANDCOVER} | {10: 0.5, 50: 0.25, 80: 0.25}
    assert {r["class"]: r.fraction for r in landcover.fractions(pixels, landcover.LANDCOVER_GROUPS).collect()} == {"water": 0.25, "pervious": 0.5, "impervious": 0.25}
    where = spark.createDataFrame([("a",), ("b",)], "name string")
    raster = spark.createDataFrame([("a", 6)], "name string, value int")
    assert {r.name: r.lcz for r in landcover.lcz(where, raster).collect()} == {"a": "Open lowrise", "b": "Water (LCZ G)"}


def test_import_of_a_dataset_in_one_plan(spark, tmp_path):
    rows = "".join(f"a,2024-06-01 12:{m:02d}:00,{v}\n" for m, v in ((0, 1), (10, 2), (10, 3), (20, "bad"), (30, 4), (41, 5), (50, 6)))
    (tmp_path / "d.csv").write_text("station,when,t\n" + rows)
    (tmp_path / "m.csv").write_text("station,lat,lon\na,50.5,4.1\nz,1,1\n")
    t = Template.build(name_column="station", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": ("t", "degC", None)}, meta_name_column="station", meta_lat_column="lat", meta_lon_column="lon")
    t.write(str(tmp_path / "t.json"))
    assert Template.load(spark, str(tmp_path / "t.json")) == t
    out = readers.import_dataset(spark, t, str(tmp_path / "d.csv"), str(tmp_path / "m.csv"))
    assert [r.label for r in out["series"].orderBy("datetime").collect()] == ["ok", "duplicated timestamp outlier", "gap", "ok", "ok", "ok"]
    assert [(r.name, r.lat) for r in out["stations"].collect()] == [("a", 50.5)]
    model = spark.createDataFrame([("a", "temp", "m", "t2m", 1.0), ("z", "temp", "m", "t2m", 2.0)], "name string, obstype string, modelname string, modelvariable string, value double")
    known = readers.add_model(out["stations"], model)
    assert [r.name for r in known.collect()] == ["a"]
    with pytest.raises(ArgumentError):
        readers.add_model(out["stations"], model, known)
    assert [r.value for r in readers.add_model(out["stations"], model.withColumn("value", F.lit(9.0)), known, force=True).collect()] == [9.0]
    both = ingest.merge_datasets(out | {"model": known}, out | {"model": known})
    assert [r.label for r in both["series"].orderBy("datetime").collect()] == ["ok", "ok", "gap", "ok", "ok", "ok"]
    assert both["stations"].count() == 1 and both["model"].count() == 1


def test_white_lists_are_checked(spark):
    from skyloom.operators import qc

    flags = qc.outliers(series(spark, [(0, 99), (1, 99)]), qc.gross_value(), "gross_value")
    for bad in ("name string, extra int", "datetime string", "station string"):
        with pytest.raises(ArgumentError):
            qc.without_white(flags, spark.createDataFrame([], bad))
    assert qc.without_white(flags, spark.createDataFrame([], "name string")).count() == 2
    assert qc.without_white(flags, spark.createDataFrame([(at(0),)], "datetime timestamp").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))).count() == 1


def test_attributes_of_an_export(spark):
    out = sinks.stacked_attributes(spark, {"temp": {"gross_value": {"lower": -15, "upper": 39}, "repetitions": {}}}, {"temp": {"interpolation": {"method": "time"}}})
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("temp", "QC", "gross_value", "lower", "-15"), ("temp", "QC", "gross_value", "upper", "39"), ("temp", "QC", "repetitions", None, None), ("temp", "GF", "interpolation", "method", "time")], key=repr)
