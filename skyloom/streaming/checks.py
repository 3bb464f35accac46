"""Beyond the reference: the same checks on unbounded observations, with Structured Streaming.

``stream`` has (name, obstype, datetime, value).  Only checks with bounded
state are here; those that look ahead run on finished days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..labels import CHECKS, OK
from ..operators.align import KEY


def gross_value(stream: DataFrame, lower: float = -15.0, upper: float = 39.0) -> DataFrame:
    """Rows with a label; values out of bounds are hidden.  Stateless."""
    bad = F.coalesce((F.col("value") < lower) | (F.col("value") > upper), F.lit(False))
    return stream.withColumn("label", F.when(bad, F.lit(CHECKS["gross_value"])).otherwise(F.lit(OK))).withColumn("value", F.when(~bad, F.col("value")))


def first_of_each_stamp(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each series and stamp; state is kept for ``late`` behind the latest stamp."""
    return stream.withWatermark("datetime", late).dropDuplicatesWithinWatermark([*KEY, "datetime"])


def window_means(stream: DataFrame, span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mean and count of each series over tumbling windows, once a window can no longer change."""
    by = stream.withWatermark("datetime", late).groupBy(*KEY, F.window("datetime", span).alias("w"))
    return by.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select(*KEY, F.col("w.start").alias("datetime"), "value", "n")
