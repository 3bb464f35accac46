"""From raw rows to labelled series on a grid: repeated stamps, rows without a number, frequency, alignment and gaps in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..labels import CHECKS, GAP, OK
from . import align
from .align import KEY
from .merge import merge_sites, upsert


def ingest(
    raw: DataFrame,
    order: str = "file_order",
    freq: str | None = None,
    freq_method: str = "median",
    freq_tolerance: str = "2min",
    origin_tolerance: str = "5min",
    timestamp_tolerance: str = "4min",
    origin: str | None = None,
    closing: str | None = None,
) -> DataFrame:
    """Rows (name, obstype, datetime, raw_timestamp, value, outlier_value, label, freq_us) of raw rows (name, obstype, datetime, value, ``order``).

    * A stamp that occurs more than once is an outlier; ``outlier_value`` has
      the value that is first by ``order``.
    * A row without value is no record: its place becomes a gap.
    * The step of each series is ``freq``, or estimated (``median`` or
      ``highest``) and rounded; series of one stamp have none and are left out.
    * Each stamp of the grid takes the nearest record within the tolerance, an
      outlier's place and stamp included; the others are gaps.
    """
    if freq_method not in ("median", "highest"):
        raise ArgumentError("the frequency is estimated as median or highest")
    once = raw.groupBy(*KEY, "datetime").agg(F.count("*").alias("n"), F.min_by("value", order).alias("first"))
    kept = once.where("n > 1 OR first IS NOT NULL")
    records = kept.select(*KEY, "datetime", F.when(F.col("n") == 1, F.col("first")).alias("value"), F.when(F.col("n") > 1, F.col("first")).alias("outlier_value"), F.when(F.col("n") > 1, F.lit(CHECKS["duplicated_timestamp"])).otherwise(F.lit(OK)).alias("label"))
    if freq is None:
        records = records.join(align.likely_frequency(records, freq_method, freq_tolerance), KEY)
        grid = align.grid_of(records, F.col("freq_us"), origin_tolerance, origin, closing)
    else:
        grid = align.grid_of(records, freq, origin_tolerance, origin, closing)
    out = align.nearest(align.grid_rows(grid), records, timestamp_tolerance, columns=("value", "outlier_value", "label"))
    return out.join(grid.select(*KEY, "freq_us"), KEY).select(*KEY, "datetime", F.col("raw_datetime").alias("raw_timestamp"), "value", "outlier_value", F.coalesce("label", F.lit(GAP)).alias("label"), "freq_us")


def merge_series(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Two ingested frames as one: outliers get their values back, the left's value counts where both have one, and series are aligned anew.

    Labels and gaps of both are lost, as frequencies may differ: checks and fills are to be run again.
    """
    restored = lambda df: df.select(*KEY, F.coalesce("raw_timestamp", "datetime").alias("datetime"), F.coalesce("value", "outlier_value").alias("value")).where("value IS NOT NULL")
    first = restored(left).withColumn("side", F.lit(0)).unionByName(restored(right).withColumn("side", F.lit(1)))
    # a grid stamp may have taken a record that its neighbour took too
    one = first.groupBy(*KEY, "datetime").agg(F.min_by("value", "side").alias("value")).withColumn("side", F.lit(0))
    return ingest(one, "side", **options)


def merge_datasets(left: dict[str, DataFrame], right: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    """Two datasets as one: ``series`` (see ``merge_series``, which takes ``options``), ``stations`` and ``model`` rows, the left's where both have a series.

    Raises where a station has two places.
    """
    out = {"series": merge_series(left["series"], right["series"], **options), "stations": merge_sites(left["stations"], right["stations"])}
    models = [d["model"] for d in (left, right) if "model" in d]
    if models:
        out["model"] = models[0] if len(models) == 1 else upsert(models[1], models[0], [*KEY, "modelname", "modelvariable"], force=True)
    return out
