"""Station metadata from exported rasters: point values, and class shares around a station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.values import haversine
from . import places

# Local climate zones by number, 1 first.
LCZ = [
    "Compact highrise", "Compact midrise", "Compact lowrise", "Open highrise", "Open midrise", "Open lowrise",
    "Lightweight lowrise", "Large lowrise", "Sparsely built", "Heavy industry", "Dense Trees (LCZ A)",
    "Scattered Trees (LCZ B)", "Bush, scrub (LCZ C)", "Low plants (LCZ D)", "Bare rock or paved (LCZ E)",
    "Bare soil or sand (LCZ F)", "Water (LCZ G)",
]
# Land-cover classes, and their groups.
LANDCOVER = {
    10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare / sparse vegetation",
    70: "Snow and ice", 80: "Permanent water bodies", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss and lichen",
}
LANDCOVER_GROUPS = {"water": [70, 80, 90, 95], "pervious": [10, 20, 30, 40, 60, 100], "impervious": [50]}


def with_coordinates(stations: DataFrame) -> DataFrame:
    return stations.dropna(subset=["lat", "lon"])


def point_values(stations: DataFrame, raster: DataFrame, classes: dict[int, str] | None = None) -> DataFrame:
    """Every station with its raster value (name, value), as the class's name where ``classes`` are given; null where there is none."""
    out = stations.select("name").join(raster.select("name", "value"), "name", "left")
    if classes is None:
        return out
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return out.withColumn("value", F.element_at(table, F.col("value").cast("int")))


def lcz(stations: DataFrame, raster: DataFrame, sea_is_water: bool = True) -> DataFrame:
    """Local climate zones; where the map has none, water."""
    found = point_values(stations, raster, dict(enumerate(LCZ, 1))).withColumnRenamed("value", "lcz")
    return found.withColumn("lcz", F.coalesce("lcz", F.lit(LCZ[16]))) if sea_is_water else found


def class_counts(pixels: DataFrame) -> DataFrame:
    """Pixels of (name, radius, class) counted: (name, radius, class, n); masked ones (null) are none."""
    return pixels.where(F.col("class").isNotNull()).groupBy("name", "radius", "class").agg(F.count("*").alias("n"))


def buffer_counts(stations: DataFrame, pixels: DataFrame, radii: list[float]) -> DataFrame:
    """Pixels of (lat, lon, class) within each of ``radii`` metres of the stations, counted: (name, radius, class, n).

    A pixel meets the stations around it by cells of a grid, once for all
    radii: it is counted in the ring between two of them, and rings are summed
    up outwards.  Stations without coordinates have no rows.
    """
    rings = sorted(set(radii))
    if not rings or rings[0] <= 0:
        raise ArgumentError("radii must be positive")
    near = places.in_near_cells(with_coordinates(stations).select("name", F.col("lat").cast("double"), F.col("lon").cast("double")), rings[-1]).withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
    known = pixels.where("class IS NOT NULL").select(F.col("lat").cast("double"), F.col("lon").cast("double"), "class")
    both = places.in_cell(known, rings[-1]).join(near, ["cy", "cx"]).withColumn("d", haversine(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")))
    ring = F.lit(None).cast("int")
    for i in reversed(range(len(rings))):
        ring = F.when(F.col("d") <= rings[i], i).otherwise(ring)
    counts = both.withColumn("ring", ring).where("ring IS NOT NULL").groupBy("name", "ring", "class").agg(F.count("*").alias("n"))
    outwards = counts.select("name", "class", "n", F.explode(F.sequence("ring", F.lit(len(rings) - 1))).alias("i"))
    return outwards.groupBy("name", F.get(F.array(*map(F.lit, rings)), F.col("i")).alias("radius"), "class").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame, groups: dict[str, list[int]] | None = None) -> DataFrame:
    """Shares (name, radius, class, fraction) of counted classes, of all pixels of a station and radius.

    Every class of the map is there, 0 where it has no pixel, and so is an
    unknown class where it has one.  With ``groups`` classes are summed into
    them; what no group names is left out, but counts in the whole.
    """
    n = F.sum("n")
    if groups is None:
        rows = counts.groupBy("name", "radius").agg(n.alias("all"), F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("int").alias("class"), "n"))).alias("of"))
        classes = F.array_union(F.array(*map(F.lit, LANDCOVER)), F.map_keys("of"))
        out = rows.select("name", "radius", "all", "of", F.explode(classes).alias("class"))
        return out.select("name", "radius", "class", (F.coalesce(F.col("of")[F.col("class")], F.lit(0)) / F.col("all")).alias("fraction"))
    sums = counts.groupBy("name", "radius").agg(n.alias("all"), *[F.sum(F.when(F.col("class").isin(c), F.col("n")).otherwise(0)).alias(f"_{g}") for g, c in groups.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("class"), (F.col(f"_{g}") / F.col("all")).alias("fraction")) for g in groups]))
    return sums.select("name", "radius", rows.alias("r")).select("name", "radius", "r.*")


def fractions(pixels: DataFrame, groups: dict[str, list[int]] | None = None) -> DataFrame:
    """Shares of classes around stations, of pixels (name, radius, class) that say which station they belong to."""
    return shares(class_counts(pixels), groups)


def buffer_fractions(stations: DataFrame, pixels: DataFrame, radii: list[float], groups: dict[str, list[int]] | None = None) -> DataFrame:
    """Shares of classes within each of ``radii`` metres of the stations, of pixels (lat, lon, class)."""
    return shares(buffer_counts(stations, pixels, radii), groups)
