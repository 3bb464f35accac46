"""Analysis: wide records, filters and aggregates by station metadata or parts of time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousError, ArgumentError, MissingError
from ..functions.conditions import condition
from ..functions.time import derivatives

AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "count": F.count, "sum": F.sum}
TIME_PARTS = ("year", "month", "hour", "minute", "second", "day_of_year", "season")


def wide(obs: DataFrame, obstypes: list[str]) -> DataFrame:
    """One row for each (datetime, name), one column for each of ``obstypes``, and the parts of time."""
    out = obs.groupBy("datetime", "name").pivot("obstype", obstypes).agg(F.first("value"))
    return out.withColumns(derivatives(F.col("datetime")))


def filter_records(records: DataFrame, text: str) -> DataFrame:
    return records.where(condition(text, records))


def filter_metadata(records: DataFrame, stations: DataFrame, text: str) -> DataFrame:
    """Records of the stations that meet the condition."""
    return records.join(stations.where(condition(text, stations)).select("name"), "name", "left_semi")


def subset_period(records: DataFrame, start, end) -> DataFrame:
    """Records from ``start`` to ``end``, both included."""
    return records.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def subset_stations(records: DataFrame, names: list[str]) -> DataFrame:
    """Records of the named stations; names that aren't there are passed over, but at least two must be asked for."""
    if len(set(names)) == 1:
        raise ArgumentError("one station is no subset; filter by its name")
    return records.where(F.col("name").isin(list(names)))


def one_series(records: DataFrame, name: str, obstype: str | None = None) -> DataFrame:
    """The records of a station (and kind); MissingError if there are none."""
    out = records.where(F.col("name") == name)
    out = out if obstype is None else out.where(F.col("obstype") == obstype)
    if out.isEmpty():
        raise MissingError(f"no records of {name!r}" + (f", {obstype!r}" if obstype else ""))
    return out


def having(records: DataFrame, obstype: str, has: bool = True) -> DataFrame:
    """Records of the stations that have (or lack) an observation kind."""
    names = records.where(F.col("obstype") == obstype).select("name").distinct()
    return records.join(names, "name", "left_semi" if has else "left_anti")


#: Functions that have a native aggregate, by their name.
NATIVE = {"mean": F.avg, "nanmean": F.avg, "average": F.avg, "amin": F.min, "min": F.min, "nanmin": F.min, "amax": F.max, "max": F.max, "nanmax": F.max, "median": F.median, "nanmedian": F.median}
#: Values of a group that a function of the user's own gets at once, at most.
GROUP_ROWS = 5_000_000


def _grouped(df: DataFrame, obstype: str, by: list[str], method: str | float | Callable, group_rows: int) -> DataFrame:
    """The aggregate of each group: a named one, a percentile (0 to 1, exact), or a function of the group's values as a pandas Series."""
    groups = df.groupBy(*by)
    if isinstance(method, float):
        if not 0 <= method <= 1:
            raise ArgumentError("a percentile lies between 0 and 1")
        return groups.agg(F.percentile(obstype, method).alias(obstype))
    if isinstance(method, str):
        return groups.agg(AGGREGATES[method](obstype).alias(obstype))
    if not callable(method):
        raise ArgumentError("an aggregate is a name, a percentile or a function")
    native = NATIVE.get(getattr(method, "__name__", "")) if getattr(method, "__module__", "").split(".")[0] == "numpy" else None
    if native is not None:
        return groups.agg(native(obstype).alias(obstype))
    if not groups.agg(F.count(obstype).alias("n")).where(F.col("n") > group_rows).isEmpty():
        raise ArgumentError(f"a group has more than {group_rows} values; name an aggregate, a percentile or finer groups")

    @F.pandas_udf("double")
    def own(values: pd.Series) -> float:
        result = method(values.dropna())
        return None if result is None else float(result)

    return groups.agg(own(F.col(obstype).cast("double")).alias(obstype))


def aggregate(records: DataFrame, obstype: str, by: list[str], method: str | float | Callable = "mean", stations: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """An aggregate of one kind's column over groups of metadata columns and parts of time; rows with a null group are dropped.

    ``method`` is a name, a percentile as a number from 0 to 1, or a function of
    a group's values (missing ones left out) that gives a number.  Numpy's means,
    medians and extremes are taken natively; other functions get a whole group,
    so a group of more than ``group_rows`` values raises.
    """
    if isinstance(method, str) and method not in AGGREGATES:
        raise ArgumentError(f"no aggregate {method!r}; there are {', '.join(AGGREGATES)}")
    df = records
    needed = [c for c in by if c not in records.columns]
    if needed:
        if stations is None or any(c not in stations.columns for c in needed):
            raise MissingError(f"unknown group columns: {needed}")
        df = df.join(stations.select("name", *needed), "name", "left")
    return _grouped(df.dropna(subset=by), obstype, by, method, group_rows)


def diurnal_cycle(records: DataFrame, obstype: str, color_by: str = "name", stations: DataFrame | None = None) -> DataFrame:
    """Mean over each time of day and group: (group, hour, minute, second, value)."""
    if color_by in ("hour", "minute", "second"):
        raise ArgumentError("a cycle of a day is not coloured by time of day")
    out = aggregate(records, obstype, [color_by, "hour", "minute", "second"], "mean", stations)
    return out.withColumnRenamed(obstype, "value")


def on_one_day(cycle: DataFrame) -> DataFrame:
    """A cycle with ``fake_datetime``, its times on 1 January 1990."""
    return cycle.withColumn("fake_datetime", F.make_timestamp(F.lit(1990), F.lit(1), F.lit(1), "hour", "minute", "second"))


def cycle_columns(cycle: DataFrame, groups: list[str], color_by: str = "name") -> DataFrame:
    """A cycle with one column for each of the given groups."""
    return on_one_day(cycle).groupBy("fake_datetime").pivot(color_by, groups).agg(F.first("value"))


def minus_reference(records: DataFrame, obstype: str, reference: str) -> DataFrame:
    """Records less the reference station's at the same stamp; null where it has none.  MissingError if the station has no records."""
    one_series(records, reference)
    ref = records.where(F.col("name") == reference).select("datetime", F.col(obstype).alias("_ref"))
    return records.join(ref, "datetime", "left").withColumn(obstype, F.col(obstype) - F.col("_ref")).drop("_ref")


def diurnal_cycle_against(records: DataFrame, obstype: str, reference: str, color_by: str = "name", stations: DataFrame | None = None) -> DataFrame:
    """The diurnal cycle of differences from a reference station; groups without any difference are there with a null."""
    return diurnal_cycle(minus_reference(records, obstype, reference), obstype, color_by, stations)


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def period(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First and last stamp, of everything or of each group."""
    return records.groupBy(*(by or [])).agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))


def kinds_present(records: DataFrame) -> DataFrame:
    return records.select("obstype").distinct()


def extent(stations: DataFrame, margin: float = 0.05) -> DataFrame:
    """The box around all stations with a margin: (lat_min, lat_max, lon_min, lon_max)."""
    box = stations.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    pad = lambda lo, hi: (F.col(hi) - F.col(lo)) * margin
    return box.select((F.col("a") - pad("a", "b")).alias("lat_min"), (F.col("b") + pad("a", "b")).alias("lat_max"), (F.col("c") - pad("c", "d")).alias("lon_min"), (F.col("d") + pad("c", "d")).alias("lon_max"))


def select_model(model: DataFrame, obstype: str, modelname: str | None = None, modelvariable: str | None = None, strict: bool = False) -> DataFrame:
    """Model rows of a kind, and of a model and variable if named.

    Where several are left, the least by (modelname, modelvariable) is taken,
    or AmbiguousError raised with ``strict``.
    """
    out = model.where(F.col("obstype") == obstype)
    for column, wanted in (("modelname", modelname), ("modelvariable", modelvariable)):
        out = out if wanted is None else out.where(F.col(column) == wanted)
    pick = out.select(F.struct("modelname", "modelvariable").alias("m"))
    if strict and pick.distinct().limit(2).count() > 1:
        raise AmbiguousError(f"several model series of {obstype!r}")
    first = F.broadcast(pick.agg(F.min("m").alias("m")))  # one row
    return out.join(first, F.struct("modelname", "modelvariable") == F.col("m"), "left_semi")


def hide_labels(labelled: DataFrame, labels: list[str]) -> DataFrame:
    """Plot-ready rows: values of the given labels are null."""
    return labelled.withColumn("value", F.when(~F.coalesce(F.col("label").isin(labels), F.lit(False)), F.col("value")))
