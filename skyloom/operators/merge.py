"""Merging of datasets, stations and series, and updates of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, MissingError


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def combine_first(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full outer merge on ``key``: the left's value where it has one, else the right's."""
    r = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return left.select(*key, *columns).join(r, key, "full").select(*key, *[F.coalesce(c, f"_r_{c}").alias(c) for c in columns])


def only_left(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), key, "left_anti")


def shared(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), key, "left_semi")


def by_id(frame: DataFrame, key: str, value) -> DataFrame:
    out = frame.where(F.col(key) == value)
    if out.isEmpty():
        raise MissingError(f"no {key} {value!r}")
    return out


def merge_sites(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stations of both: the first non-null altitude and class; of maps, the right's entries win.

    Raises where a station's coordinates differ (two nulls are equal).
    """
    r = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    both = left.join(r, F.col("name") == F.col("_name"), "full")
    known = F.col("name").isNotNull() & F.col("_name").isNotNull()
    if not both.where(known & ~(F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")))).isEmpty():
        raise ArgumentError("a station has two places")
    maps = {c for c, t in left.dtypes if t.startswith("map")}
    nothing = lambda c: F.coalesce(F.col(c), F.create_map().cast(dict(left.dtypes)[c.lstrip("_")]))
    merged = lambda c: F.map_concat(F.map_filter(nothing(c), lambda k, _: ~F.array_contains(F.map_keys(nothing(f"_{c}")), k)), nothing(f"_{c}"))
    return both.select(*[merged(c).alias(c) if c in maps else F.coalesce(c, f"_{c}").alias(c) for c in left.columns])


def dedupe_first(frame: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def require_unique(frame: DataFrame, key: list[str]) -> DataFrame:
    if not frame.groupBy(*key).count().where("count > 1").isEmpty():
        raise ArgumentError(f"{key} is not unique")
    return frame


def upsert(frame: DataFrame, new: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """``frame`` with the rows of ``new``; keys that are there already raise, or are replaced with ``force``."""
    if not force and not shared(frame, new, key).isEmpty():
        raise ArgumentError(f"{key} is there already")
    return union_all(only_left(frame, new, key), new)


def rename_stations(frame: DataFrame, names: dict[str, str], stations: DataFrame | None = None) -> DataFrame:
    """Rows with station names changed; unknown sources and targets that are taken are passed over."""
    asked = {k: v for k, v in names.items() if k != v}
    known = stations if stations is not None else frame
    taken = {r[0] for r in known.where(F.col("name").isin(list(set(asked.values())))).select("name").distinct().collect()}  # at most the names asked for
    use = {k: v for k, v in asked.items() if v not in taken}
    if not use:
        return frame
    table = F.create_map(*[F.lit(x) for kv in use.items() for x in kv])
    return frame.withColumn("name", F.coalesce(F.element_at(table, F.col("name")), F.col("name")))


def update_dimension(stations: DataFrame, new: DataFrame, column: str, default: Column | None = None, overwrite: bool = True) -> DataFrame:
    """``stations`` with ``column`` from ``new`` (name, column), kept where ``new`` has none; ``default`` where both have none."""
    kind = dict(stations.dtypes).get(column)
    joined = stations.join(new.select("name", F.col(column).alias("_new")), "name", "left")
    old = F.col(column) if kind else F.lit(None)
    value = F.coalesce(F.col("_new"), old) if overwrite else F.coalesce(old, F.col("_new"))
    return joined.withColumn(column, value if default is None else F.coalesce(value, default)).drop("_new")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same rows, as often."""
    columns = sorted(left.columns)
    return columns == sorted(right.columns) and left.select(columns).exceptAll(right.select(columns)).isEmpty() and right.select(columns).exceptAll(left.select(columns)).isEmpty()


def join_texts(left: str | None, right: str | None) -> str | None:
    """Two descriptions as one."""
    if left == right or right is None:
        return left
    return right if left is None else f"{left} +++ {right}"
