"""Readers: files to observations, stations and model series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, TemplateError
from ..functions import time as T
from ..functions import units
from ..functions import values as V
from ..operators.align import KEY
from ..operators.ingest import ingest
from ..operators.merge import upsert
from ..operators.qc import duplicated_timestamps, without_duplicates
from .template import RESERVED, Template

SEPARATORS = (",", ";", "\t", "|", " ")
# Date format codes and Spark's patterns for them.
_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%z": "Z", "%%": "%"}


def pattern(fmt: str) -> str:
    """A strftime format as a Spark datetime pattern."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] not in _CODES:
                raise ArgumentError(f"format code {fmt[i : i + 2]!r} is not handled")
            out.append(_CODES[fmt[i : i + 2]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV file with a header, or several, all columns text.

    Without ``sep`` the first separator that gives several columns is taken.
    Files with other columns are read by their own header and meet by name;
    what one of them lacks is null.
    """
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    if len(lines.inputFiles()) == 1:
        heads = lines.limit(1).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("head"))
    else:  # every file's first line
        heads = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").where("place.file_block_start = 0").groupBy("file").agg(F.min_by("value", "place").alias("head"))
    # one row for each header; its files are those that Spark's own listing holds
    kinds = heads.groupBy("head").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0]).collect()
    if not kinds:
        raise ArgumentError(f"{path} is empty")
    out = None
    for head, files in kinds:
        own = sep or next((s for s in SEPARATORS if s in head), None)
        if own is None:
            raise ArgumentError(f"no separator found in the header of {path}")
        part = spark.read.csv(path if len(kinds) == 1 else files, header=True, sep=own, multiLine=False)
        if len(kinds) > 1:
            part = part.withColumn(FILE_ORDER, file_order(part))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: Where a row stands in its file, kept where files are put together.
FILE_ORDER = "_file_order"


def file_order(df: DataFrame) -> Column:
    """The place of a row in the files that ``df`` reads: by path, then by place in the file.

    Spark packs files into tasks by their size, so the number of a row alone
    doesn't follow the files.  A frame that reads no files keeps its own order.
    """
    if FILE_ORDER in df.columns:
        return F.col(FILE_ORDER)
    number = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), number.alias("number"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), number.alias("number"))


def rejected(df: DataFrame, t: Template) -> DataFrame:
    """Rows that can't be used, (file, reason, text): those without a stamp that fits the format, or without a name."""
    own = [c for c in df.columns if c != FILE_ORDER]
    nameless = F.col(f"`{t.name_column}`").isNull() if t.structure == "long" else F.lit(False)
    reason = F.when(datetimes(df, t).isNull(), "no stamp").when(nameless, "no name")
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))
    return df.withColumn("_reason", reason).where("_reason IS NOT NULL").select(file_order(df)["file"].alias("file"), F.col("_reason").alias("reason"), text.alias("text"))


READERS = {".csv": csv, ".parquet": lambda spark, path: spark.read.parquet(path), ".json": lambda spark, path: spark.read.json(path)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix."""
    for suffix, reader in READERS.items():
        if path.rstrip("/").endswith(suffix):
            return reader(spark, path)
    raise ArgumentError(f"no reader for {path}")


def _set_aside_reserved(df: DataFrame, mapped: list[str | None]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_original" for c in df.columns if c in RESERVED and c not in mapped})


def datetimes(df: DataFrame, t: Template) -> Column:
    """The stamp of a row in UTC; text that the format doesn't fit is null, and so is a local time that doesn't exist."""
    if t.datetime_column:
        raw = F.col(f"`{t.datetime_column}`")
        if dict(df.dtypes)[t.datetime_column].startswith("timestamp"):
            local = raw.cast("timestamp_ntz")
        else:
            local = F.try_to_timestamp(raw, F.lit(pattern(t.datetime_format or "%Y-%m-%d %H:%M:%S"))).cast("timestamp_ntz")
    else:
        text = F.concat_ws(" ", F.col(f"`{t.date_column}`"), F.col(f"`{t.time_column}`"))
        local = F.try_to_timestamp(text, F.lit(f"{pattern(t.date_format or '%Y-%m-%d')} {pattern(t.time_format or '%H:%M:%S')}")).cast("timestamp_ntz")
    if t.timezone == "UTC":
        return local.cast("timestamp")
    utc = F.to_utc_timestamp(local.cast("timestamp"), t.timezone)
    return F.when(F.from_utc_timestamp(utc, t.timezone) == local.cast("timestamp"), utc)


def wide_to_long(df: DataFrame, ids: list[str], obstype: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each station column: (ids…, name, obstype column)."""
    stations = columns if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, stations, "name", obstype)


def observations(df: DataFrame, t: Template) -> DataFrame:
    """Raw rows as (name, obstype, datetime, value, raw, file_order), values as numbers in standard units (null: no number)."""
    missing = [c for c in t.columns() if c not in df.columns]
    if missing:
        raise TemplateError(f"columns that the file lacks: {missing}")
    df = df.withColumn("file_order", file_order(df)).drop(FILE_ORDER)
    df = _set_aside_reserved(df, t.columns() if t.structure != "wide" else df.columns)
    df = df.withColumn("_stamp", datetimes(df, t))
    if t.structure == "wide":
        (kind, _), skip = next(iter(t.obstypes.items())), {t.datetime_column, t.date_column, t.time_column, "_stamp", "file_order"}
        stations = [c for c in df.columns if c not in skip]
        texts = df.select("_stamp", "file_order", *[F.col(f"`{c}`").cast("string").alias(c) for c in stations])
        long = texts.unpivot(["_stamp", "file_order"], [F.col(f"`{c}`") for c in stations], "name", "raw").withColumn("obstype", F.lit(kind))
    else:
        name = F.lit(t.single_name) if t.structure == "single_station" else F.col(f"`{t.name_column}`").cast("string")
        held = F.explode(F.array(*[F.struct(F.lit(k).alias("obstype"), F.col(f"`{c}`").cast("string").alias("raw")) for k, (c, _, _) in t.obstypes.items()]))
        long = df.select("_stamp", "file_order", name.alias("name"), held.alias("x")).select("_stamp", "file_order", "name", "x.*")
    value = V.number(F.col("raw"))
    converted = F.lit(None).cast("double")
    for kind, (_, unit, _) in t.obstypes.items():
        standard = units.KINDS.get(kind, (unit,))[0]
        own = units.convert(value, unit, standard) if unit and standard else value
        converted = F.when(F.col("obstype") == kind, own).otherwise(converted)
    return long.where("name IS NOT NULL AND _stamp IS NOT NULL").select("name", "obstype", F.col("_stamp").alias("datetime"), converted.alias("value"), "raw", "file_order")


def stations(df: DataFrame, t: Template) -> DataFrame:
    """Metadata rows as (name, lat, lon, altitude, extra map): the first row of each name in file order."""
    mapped = [t.meta_name_column, t.meta_lat_column, t.meta_lon_column, t.meta_altitude_column, *t.meta_extra]
    df = df.withColumn("_order", file_order(df)).drop(FILE_ORDER)
    df = _set_aside_reserved(df, mapped)
    number = lambda c: V.number(F.col(f"`{c}`")) if c else F.lit(None).cast("double")
    name = F.col(f"`{t.meta_name_column}`").cast("string") if t.meta_name_column else F.lit(t.single_name)
    extra = F.create_map(*[x for c in t.meta_extra if c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).cast("map<string,string>")
    out = df.select(name.alias("name"), number(t.meta_lat_column).alias("lat"), number(t.meta_lon_column).alias("lon"), number(t.meta_altitude_column).alias("altitude"), extra.alias("extra"), "_order")
    first = Window.partitionBy("name").orderBy("_order")
    return out.where("name IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_order")


def single_name(data: DataFrame, meta: DataFrame) -> DataFrame:
    """A single station's records under the name that its metadata has; more than one row of metadata raises."""
    names = [r[0] for r in meta.select("name").limit(2).collect()]
    if len(names) != 1:
        raise TemplateError("metadata of a single station must have one row")
    return data.withColumn("name", F.lit(names[0]))


def usable(obs: DataFrame, min_records: int = 3) -> DataFrame:
    """Without stations of fewer than ``min_records`` rows and series without any value."""
    per_station = obs.groupBy("name").agg(F.countDistinct("file_order").alias("n")).where(F.col("n") >= min_records).select("name")
    valued = obs.where("value IS NOT NULL").select(*KEY).distinct()
    return obs.join(per_station, "name", "left_semi").join(valued, KEY, "left_semi")


def import_data(spark: SparkSession, template: Template, data_path: str, metadata_path: str | None = None) -> dict[str, DataFrame]:
    """Read, map and check a dataset: ``obs`` (one row a stamp), ``outliers`` (repeated stamps), ``stations`` and ``rejected`` rows.

    Stamps that occur twice keep no value; rows without a number become gaps once aligned.
    """
    raw = read(spark, data_path)
    rows = observations(raw, template)
    meta = stations(read(spark, metadata_path), template) if metadata_path else None
    if meta is not None and template.structure == "single_station":
        rows = single_name(rows, meta)
    rows = usable(rows)
    repeated = duplicated_timestamps(rows, "file_order")
    clean = without_duplicates(rows, "file_order")
    invalid = rows.where("value IS NULL").select(*KEY, "datetime").join(repeated.select(*KEY, "datetime"), [*KEY, "datetime"], "left_anti")
    obs = clean.join(invalid.distinct(), [*KEY, "datetime"], "left_anti")
    return {"obs": obs, "outliers": repeated, "stations": _known(rows, meta), "rejected": rejected(raw, template)}


def import_dataset(spark: SparkSession, template: Template, data_path: str, metadata_path: str | None = None, **options) -> dict[str, DataFrame]:
    """A file to labelled series on their grids, in one plan: ``series`` (see ``ingest``, which takes ``options``) and ``stations``."""
    rows = observations(read(spark, data_path), template)
    meta = stations(read(spark, metadata_path), template) if metadata_path else None
    if meta is not None and template.structure == "single_station":
        rows = single_name(rows, meta)
    rows = usable(rows)
    return {"series": ingest(rows, "file_order", **options), "stations": _known(rows, meta)}


def _known(rows: DataFrame, meta: DataFrame | None) -> DataFrame:
    """The stations that have records, with what the metadata says of them."""
    names = rows.select("name").distinct()
    if meta is not None:
        return names.join(meta, "name", "left")
    return names.select("name", *[F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "altitude")], F.lit(None).cast("map<string,string>").alias("extra"))


def add_model(stations: DataFrame, model: DataFrame, present: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Model rows of the known stations, added to those that are ``present``; a series that is there already raises, or is replaced with ``force``."""
    new = model.join(stations.select("name").distinct(), "name", "left_semi")
    return new if present is None else upsert(present, new, [*KEY, "modelname", "modelvariable"], force)


def model_series(df: DataFrame, modelname: str, bands: dict[str, tuple[str, str]], vector: tuple[str, str] | None = None) -> DataFrame:
    """An exported model table (name, datetime as yyyyMMddHHmmss, a column for each band) as long model rows.

    ``bands`` maps a kind to its column and unit; ``vector`` names the columns
    of a wind's two components, which become wind_speed and wind_direction.
    Columns that aren't named are passed over.
    """
    stamp = F.to_timestamp(F.col("datetime").cast("string"), "yyyyMMddHHmmss")
    rows = []
    for kind, (column, unit) in bands.items():
        if column in df.columns:
            value = units.convert(V.number(F.col(column)), unit, units.KINDS[kind][0])
            rows.append(F.struct(F.lit(kind).alias("obstype"), F.lit(column).alias("modelvariable"), value.alias("value")))
    if vector and all(c in df.columns for c in vector):
        u, v = (V.number(F.col(c)) for c in vector)
        for kind, value in (("wind_speed", V.amplitude(u, v)), ("wind_direction", V.direction(u, v))):
            rows.append(F.struct(F.lit(kind).alias("obstype"), F.lit("+".join(vector)).alias("modelvariable"), value.alias("value")))
    return df.select(F.col("name").cast("string").alias("name"), stamp.alias("datetime"), F.explode(F.array(*rows)).alias("x")).select("name", "x.obstype", F.lit(modelname).alias("modelname"), "x.modelvariable", "datetime", "x.value")


@dataclass(frozen=True)
class Raster:
    """A regular grid: the centre of its first cell and the steps between centres, in degrees, and its step in time."""

    lat: float
    lon: float
    lat_step: float
    lon_step: float
    time_step: str = "1h"

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """The cell that holds a place, by arithmetic; a place on a border belongs to the next cell."""
        return F.floor((lat - self.lat) / self.lat_step + 0.5), F.floor((lon - self.lon) / self.lon_step + 0.5)


def sample_model(grid: DataFrame, raster: Raster, stations: DataFrame, modelname: str, bands: dict[str, tuple[str, str]], start: str, end: str, day_column: str | None = None) -> DataFrame:
    """Model rows (name, obstype, modelname, modelvariable, datetime, value) of the cells that hold the stations.

    ``grid`` has (time, lat, lon, band, value), lat and lon being cell centres;
    ``bands`` maps a kind to its band and unit.  The period runs from ``start``
    to one step of time after ``end``, that stamp itself excluded.  With
    ``day_column``, a date by which the grid is partitioned, only the days of
    the period are read.  Stations meet cells by their numbers; stations without
    coordinates, or outside the grid, have no rows.
    """
    for _, unit in bands.values():
        units.parse(unit)
    found = sampled(grid, raster, stations, sorted({b for b, _ in bands.values()}), start, end, day_column)
    kinds = F.array(*[F.when(F.col("band") == band, F.struct(F.lit(kind).alias("obstype"), units.convert(F.col("value"), unit, units.KINDS[kind][0]).alias("value"))) for kind, (band, unit) in bands.items()])
    out = found.withColumn("x", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return out.select("name", "x.obstype", F.lit(modelname).alias("modelname"), F.col("band").alias("modelvariable"), F.col("time").alias("datetime"), "x.value")


def sampled(grid: DataFrame, raster: Raster, stations: DataFrame, bands: list[str], start: str, end: str, day_column: str | None = None) -> DataFrame:
    """Rows (name, time, band, value) of the cells that hold the stations; bands and period as ``sample_model`` takes them."""
    first, last = F.lit(start).cast("timestamp"), F.timestamp_micros(T.to_micros(F.lit(end).cast("timestamp")) + T.micros(raster.time_step))
    wanted = grid.where((F.col("time") >= first) & (F.col("time") < last) & F.col("band").isin(bands))
    if day_column:
        wanted = wanted.where(F.col(day_column).between(F.to_date(first), F.to_date(last)))
    row, column = raster.cell(F.col("lat").cast("double"), F.col("lon").cast("double"))
    cells = wanted.select("time", "band", F.col("value").cast("double").alias("value"), row.alias("row"), column.alias("column"))
    places = stations.dropna(subset=["lat", "lon"]).select("name", row.alias("row"), column.alias("column"))
    return cells.join(places, ["row", "column"]).select("name", "time", "band", "value")
