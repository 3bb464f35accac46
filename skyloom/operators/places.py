"""Places that are near each other: a grid of cells makes a range join an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_194.0


def _height(radius_m: float) -> float:
    return radius_m / METRES_PER_DEGREE * 1.001


def _cells(height: float) -> Column:
    """Cells in a row of latitude ``cy``: as wide as the radius where the row is nearest a pole; around a pole there is one."""
    pole = F.greatest(F.abs(F.col("cy") * height), F.abs((F.col("cy") + 1) * height)) + height
    return F.when(pole < 89.9, F.greatest(F.lit(1), F.floor(F.lit(360.0) / (F.lit(height) / F.cos(F.radians(pole)))))).otherwise(1).cast("long")


def _column(cells: Column) -> Column:
    return F.floor((F.col("lon") + 180) / (F.lit(360.0) / cells))


def in_cell(df: DataFrame, radius_m: float) -> DataFrame:
    """``df`` of (lat, lon) with the cell (cy, cx) of each row."""
    cells = _cells(_height(radius_m))
    return df.withColumn("cy", F.floor(F.col("lat") / _height(radius_m))).withColumn("cx", F.pmod(_column(cells), cells))


def in_near_cells(df: DataFrame, radius_m: float) -> DataFrame:
    """``df`` with one row for each cell that a circle of the radius can touch, nine at most."""
    cells = _cells(_height(radius_m))
    rows = df.withColumn("cy", F.floor(F.col("lat") / _height(radius_m)))
    rows = rows.withColumn("cy", F.explode(F.array(*[F.col("cy") + d for d in (-1, 0, 1)])))
    return rows.withColumn("cx", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(_column(cells) + d, cells)))))
